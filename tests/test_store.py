from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.functions import labels as L
from docpipe.operators import store as R
from docpipe.plans.retention import apply_retention
from docpipe.sources.tables import chunk_rows, record_id, record_rows, write_table

AS_OF = datetime(2024, 3, 1, 12)
DAY, MS = timedelta(days=1), timedelta(milliseconds=1)


@pytest.fixture
def records(spark):
    ages = {"new": 0 * DAY, "day": DAY, "day+": DAY + MS, "two": 2 * DAY, "month": 30 * DAY, "month+": 30 * DAY + MS, "old": 31 * DAY}
    rows = [(k, f"u/{k}", "text/html", AS_OF - age) for k, age in ages.items()]
    return spark.createDataFrame(rows, "record_id string, url string, content_type string, fetched_at timestamp")


@pytest.fixture
def chunks(spark):
    rows = [("new", 0, "a", "A", "first", 5), ("new", 1, "b", "B", "second", 1536), ("new", 2, "a", "A2", "third", 5), ("old", 0, "a", "A", "x", 1)]
    return spark.createDataFrame(rows, "record_id string, chunk_index int, key string, title string, content string, size_bytes long")


def test_status_limits_are_strict(records):
    got = {r.record_id: r.status for r in R.record_status(records, AS_OF).collect()}
    assert got == {"new": "fresh", "day": "fresh", "day+": "stale", "two": "stale", "month": "stale", "month+": "expired", "old": "expired"}


def test_list_is_newest_first(records):
    assert [r.record_id for r in R.list_records(records, AS_OF).collect()] == ["new", "day", "day+", "two", "month"]


def test_resolve(spark, records, chunks):
    requests = spark.createDataFrame([("new",), ("two",), ("old",), ("none",)], "record_id string")
    rows = R.resolve_records(records, chunks, requests, AS_OF).orderBy("record_id", "chunk_index").collect()
    assert [(r.record_id, r.chunk_index) for r in rows] == [("new", 0), ("new", 1), ("new", 2), ("two", None)]


def test_lookup(spark, records, chunks):
    requests = spark.createDataFrame([("new", "a"), ("new", "z"), ("old", "a"), ("none", "a")], "record_id string, key string")
    (hit,) = R.chunk_lookup(records, chunks, requests, AS_OF).collect()
    assert (hit.record_id, hit.key, hit.content) == ("new", "a", "first")
    misses = {(r.record_id, r.key): r.reason for r in R.lookup_misses(records, chunks, requests, AS_OF).collect()}
    assert misses == {("new", "z"): "chunk not found", ("old", "a"): "record not found", ("none", "a"): "record not found"}


def test_summary_index_duplicates(records, chunks):
    got = {r.record_id: tuple(r)[1:] for r in R.record_summary(chunks).collect()}
    assert got == {"new": (1546, 3, "1.5 KB", "a", "first"), "old": (1, 1, "1 B", "a", "x")}
    lines = [r.line for r in R.record_index(records, chunks, AS_OF).filter("record_id = 'new'").orderBy("line_no").collect()]
    assert lines == [
        "URL: u/new", "Type: text/html", "Fetched: 2024-03-01T12:00:00.000Z", "Status: fresh", "", "Chunks:",
        "   1. A  (5 B)", "   2. B  (1.5 KB)", "   3. A2  (5 B)",
    ]
    (dup,) = R.duplicate_chunk_keys(chunks).collect()
    assert (dup.record_id, dup.key, dup.n_chunks, dup.first_index) == ("new", "a", 2, 0)


def test_retention_of_unreadable_times(spark, records):
    extra = spark.createDataFrame(
        [("x", None, AS_OF - 31 * DAY), ("y", None, AS_OF), ("z", None, None)],
        "record_id string, fetched_at timestamp, ingested_at timestamp",
    )
    kept = {r.record_id for r in R.retention_survivors(extra, AS_OF).collect()}
    assert kept == {"y", "z"}
    (counts,) = R.retention_counts(records, AS_OF).collect()
    assert tuple(counts) == (7, 2, 5)


def test_labels(apply):
    sizes = [0, 1023, 1024, 1280, 1_048_575, 1_048_576, 5 * 1_048_576 + 524_288]
    got = apply(sizes, L.size_label(F.col("v")), "long")
    assert got == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "5.5 MB"]
    ages = [timedelta(seconds=24), timedelta(seconds=30), timedelta(seconds=59.5 * 60), timedelta(hours=23, minutes=59), timedelta(days=3)]
    minutes = L.age_minutes(F.col("v"), AS_OF)
    assert apply([AS_OF - a for a in ages], L.age_label(minutes), "timestamp") == ["just now", "1m ago", "1h ago", "23h ago", "3d ago"]


def test_rows_and_ids(spark):
    df = spark.createDataFrame([("u", "t", AS_OF), ("u", "t", AS_OF), ("v", "t", AS_OF)], "url string, content_type string, fetched_at timestamp")
    ids = [r.record_id for r in record_rows(df).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 32
    row = chunk_rows(df.limit(1).select(record_id(F.col("url"), F.col("fetched_at")).alias("record_id"), F.lit(0).alias("chunk_index"),
        F.lit("k").alias("key"), F.lit("t").alias("title"), F.lit("é").alias("content"), "fetched_at")).first()
    assert row.size_bytes == 2 and row.expires_at - row.created_at == DAY


def test_retention_job(spark, tmp_path):
    rows = [(f"r{i}", AS_OF - timedelta(hours=6 * i)) for i in range(160)]
    df = spark.createDataFrame(rows, "record_id string, fetched_at timestamp").withColumn("fetched_date", F.to_date("fetched_at"))
    write_table(df, str(tmp_path / "records"), cluster=True)
    write_table(df.withColumn("created_at", F.col("fetched_at")), str(tmp_path / "chunks"))
    deleted = apply_retention(spark, str(tmp_path / "records"), str(tmp_path / "chunks"), AS_OF)
    kept = {r for r, at in rows if AS_OF - at <= 30 * DAY}
    assert deleted == 160 - len(kept)
    for name in ("records", "chunks"):
        spark.catalog.refreshByPath(str(tmp_path / name))
        assert {r.record_id for r in spark.read.parquet(str(tmp_path / name)).collect()} == kept
