from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docpipe.operators import store as R
from docpipe.plans import lookup as L

AS_OF = datetime(2024, 3, 1)
RECORDS, CHUNKS = 200, 50


@pytest.fixture(scope="module")
def chunks(spark):
    n = F.col("id")
    return spark.range(RECORDS * CHUNKS).select(
        F.concat(F.lit("r"), F.lpad((n % RECORDS).cast("string"), 4, "0")).alias("record_id"),
        F.floor(n / RECORDS).cast("int").alias("chunk_index"),
        F.concat(F.lit("k"), (F.floor(n / RECORDS) % 40).cast("string")).alias("key"),
        F.lit("t").alias("title"),
        F.sha2(n.cast("string"), 256).alias("content"),
    )


@pytest.fixture(scope="module")
def path(spark, chunks, tmp_path_factory):
    """A table of two parts with different numbers of buckets."""
    path = str(tmp_path_factory.mktemp("lookup") / "chunks")
    old = F.col("record_id") < "r0050"
    L.write_lookup(chunks.filter(old), path, 50 * CHUNKS, per_bucket=1_000, page_rows=100)
    L.write_lookup(chunks.filter(~old), path, 150 * CHUNKS, per_bucket=1_000, page_rows=100)
    return path


def scanned(df):
    """(files, rows) that the scan of df read."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return tuple(scan.metrics().apply(name).value() for name in ("numFiles", "numOutputRows"))


def requests(spark, ids, key="k3"):
    return spark.createDataFrame([(i, key) for i in ids], "record_id string, key string")


def test_few_files_and_rows_are_read(spark, path):
    files, rows = scanned(spark.read.parquet(path))
    assert rows == RECORDS * CHUNKS and files >= 8
    part = L.requested_chunks(spark, path, requests(spark, ["r0007", "r0123"]))
    some_files, some_rows = scanned(part)
    assert part.count() == 2 * CHUNKS and some_files <= 4 and some_rows <= RECORDS * CHUNKS / 10


def test_bloom_filters_skip_what_lies_between(spark, path):
    """Ids that are no record, though the files hold smaller and larger ones."""
    read = [scanned(L.requested_chunks(spark, path, requests(spark, [f"r{i:04}x"])))[1] for i in range(20, 30)]
    assert sum(r == 0 for r in read) >= 8


def test_many_requests_are_joined(spark, chunks, path, monkeypatch):
    monkeypatch.setattr(L, "MOST_LITERALS", 3)
    records = chunks.select("record_id").distinct().withColumns({"url": F.lit("u"), "content_type": F.lit("t"), "fetched_at": F.lit(AS_OF)})
    for ids in (["r0001", "r0060", "none", None], [f"r{i:04}" for i in range(0, 250, 7)] + ["r0007"], []):
        wanted = requests(spark, ids)
        got = sorted(map(tuple, L.lookup(records, path, wanted, AS_OF).collect()))
        assert got == sorted(map(tuple, R.chunk_lookup(records, chunks, wanted, AS_OF).collect()))
        assert len(got) == len({i for i in ids if i and i != "none" and i < "r0200"})


def test_a_large_record_is_spread(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "CHUNKS_PER_FILE", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        L.write_lookup(chunks.filter("record_id = 'r0001'"), str(tmp_path / "c"), CHUNKS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spark.read.parquet(str(tmp_path / "c")).inputFiles()) > 1
