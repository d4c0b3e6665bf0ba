"""Shards of near equal bytes: groups of equal texts, largest first, each to the shard with the least so far.

Longest-processing-time scheduling looks at one item after the other, so the items must be few whatever the table's
size. A group above a fixed fraction of all bytes is an item by itself; smaller groups are put together to bundles by a
hash of their text. With `pieces` items per shard of either kind at most (a bound by arithmetic, not a cap), the heap
runs over a table of bounded size, and shards differ by about 1 / pieces of a shard, or by one group that is larger.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, with_rank, written

SHARDS = 24
PIECES = 500
ROW_OVERHEAD = 8


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each item (size, name): by falling size, ties by name, to the least loaded shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    heapify(heap)
    places = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        places[name] = shard
        heapreplace(heap, (load + size, shard))
    return places


def shard_documents(docs: DataFrame, shards: int = SHARDS, pieces: int = PIECES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    Equal texts share a shard. A null text counts as empty; repeated rows are rows like others, so their texts' group
    grows. slot numbers the rows of a shard from 0 without gaps. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = body(text_column)
    rows = written(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        ).withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(shards * pieces)).cast("int")),
        "rows",
    )
    groups = rows.groupBy("key", "bundle").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "groups")
    whole = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    large = F.col("bytes") > whole["bytes"] // (shards * pieces)
    # Fewer than shards * pieces groups can be large, and there are as many bundles.
    alone = groups.filter(large).select("key", "bytes").toArrow().to_pydict()
    bundled = groups.filter(~large).groupBy("bundle").agg(F.sum("bytes").alias("bytes")).toArrow().to_pydict()
    keys = [k.hex() for k in alone["key"]]
    names = [f"b{b}" for b in bundled["bundle"]]
    places = schedule([*zip(alone["bytes"], keys, strict=True), *zip(bundled["bytes"], names, strict=True)], shards)
    of_group = spark.createDataFrame(
        pa.table({"key": pa.array(alone["key"], pa.binary()), "_own": pa.array([places[k] for k in keys], pa.int32())})
    )
    of_bundle = spark.createDataFrame(
        pa.table({"bundle": pa.array(bundled["bundle"], pa.int32()), "_with": pa.array([places[b] for b in names], pa.int32())})
    )
    placed = rows.join(F.broadcast(of_group), "key", "left").join(F.broadcast(of_bundle), "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", "key", F.coalesce("_own", "_with").alias("shard"))
    return with_rank(placed, "shard", ["doc_id", "key"], "slot", whole["n"]).drop("key")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
