"""Chunk tables laid out for point lookups: a request reads the buckets, row groups and pages that can hold its record.

    <path>/buckets=<n>/bucket=<hash of record_id modulo n>/...    sorted by record_id and chunk_index

The number of buckets grows with the rows that are written at a time; a table may hold parts of several sizes, each
under its own `buckets`. Files carry Bloom filters on record_id and key, and small pages whose bounds are narrow because
the rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.operators import store
from docpipe.plans.publish import Files

ROWS_PER_BUCKET = 500_000
#: Bounds the buckets that a lookup collects, whatever the number of requests.
MOST_BUCKETS = 4_096
#: A record with more chunks is spread over files and tasks.
CHUNKS_PER_FILE = 100_000
#: So many ids are handed to the scan as values; more of them are joined.
MOST_LITERALS = 200
PAGE_ROWS = 1_000


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int")


def write_lookup(chunks: DataFrame, path: str, rows: int, per_bucket: int = ROWS_PER_BUCKET, page_rows: int = PAGE_ROWS) -> None:
    """Add chunks to the table at `path`; `rows` is about their number, as the manifest of a run states it."""
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * per_bucket < rows:
        buckets *= 2
    laid = chunks.withColumn("bucket", _bucket(buckets))
    laid = laid.repartition(F.col("bucket"), F.floor(F.col("chunk_index") / CHUNKS_PER_FILE))
    writer = laid.sortWithinPartitions("bucket", "record_id", "chunk_index").write.mode("append").partitionBy("bucket")
    for column in ("record_id", "key"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.page.row.count.limit", page_rows).parquet(f"{path}/buckets={buckets}")


def requested_chunks(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """The rows of the table in the buckets of the requested records; of these records only, where they are few.

    At the driver arrive at most MOST_BUCKETS numbers twice over and MOST_LITERALS + 1 ids.
    """
    ids = requests.select("record_id").filter("record_id IS NOT NULL").distinct()
    sizes = sorted(int(name.removeprefix("buckets=")) for f in Files(spark).children(path) if (name := f.getPath().getName()).startswith("buckets="))
    rows = spark.read.parquet(path)
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("buckets"), _bucket(n).alias("bucket")) for n in sizes]))
    found: dict[int, list[int]] = {}
    for r in ids.select(places.alias("p")).select("p.*").distinct().collect():
        found.setdefault(r["buckets"], []).append(r["bucket"])
    inside = F.lit(False)
    for n, buckets in sorted(found.items()):
        inside |= (F.col("buckets") == n) & F.col("bucket").isin(sorted(buckets))
    few = [r["record_id"] for r in ids.limit(MOST_LITERALS + 1).collect()]
    if len(few) <= MOST_LITERALS:
        inside &= F.col("record_id").isin(sorted(few))
    return rows.filter(inside).drop("buckets", "bucket")


def lookup(records: DataFrame, path: str, requests: DataFrame, as_of: store.AsOf) -> DataFrame:
    """`chunk_lookup` on a table that `write_lookup` wrote."""
    return store.chunk_lookup(records, requested_chunks(records.sparkSession, path, requests), requests, as_of)
