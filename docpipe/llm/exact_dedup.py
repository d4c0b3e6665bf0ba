"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

New rows are reduced to one digest each, grouped, compared with the index by a sort-merge anti-join, and what is new is
appended. The index side of the join is read bucket by bucket and never shuffled.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, fresh, scratch, table, text_hash, without, written

BUCKETS = 16


def normalised(column: str = "text") -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(body(column), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, digest): SHA-256 of the normalised text as 32 bytes. Other columns are left aside."""
    digest = F.unhex(F.sha2(normalised(text_column), 256))
    return docs.select(F.col(id_column).alias("doc_id"), text_hash(text_column).alias("text_hash"), digest.alias("digest"))


class DigestIndex:
    """A table (digest, keep_id) in a folder; it outlives the session and is opened again by its path.

    buckets is fixed when the index is made. At 100 TB of texts (some 10^11 digests of 40 bytes) take about 4,000.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.buckets = buckets
        self.name = f"digest_index_{md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the digests of groups (digest, keep_id, ...) that are not there yet; a repeated call adds nothing."""
        new = groups.select("digest", "keep_id").join(self.table().hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def deduplicate(self, rows: DataFrame) -> DataFrame:
        """Decide on a batch of digests() and add it to the index.

        Returns one row per row of the batch: doc_id, text_hash, digest, keep_id, group_size, kept.

        * keep_id is the document that stays for this text: of an earlier batch if one had it, else the smallest doc_id
          of this batch. group_size counts the rows of this batch with the text.
        * Repeated rows (same doc_id and text) get the same answer. A null doc_id is kept only if all rows of its text
          have none. An empty batch gives an empty result.
        """
        groups = written(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        self.add(groups)
        settled = written(groups.select("digest", "group_size").join(self.table().hint("merge"), "digest"), "settled")
        # A text may have any number of rows: both sides are plain shuffles, so that a hot digest is split at run time.
        return rows.join(settled, "digest", "left").select(
            "doc_id", "text_hash", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
        )


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decisions on all rows of docs (doc_id, text, ...), against a given index or a new one."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, f"{scratch(spark)}/index")
    return index.deduplicate(written(digests(docs), "digests"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """docs without the rows that have a text of another row; of repeated rows (same doc_id and text) one stays."""
    found = written(exact_duplicates(docs, index), "decisions")
    keys = {"doc_id": F.col("doc_id"), "text_hash": text_hash()}
    kept = without(docs, found.filter(~F.col("kept")), keys)
    repeated = found.filter("kept").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return kept
    name = fresh(docs, "_text")
    return kept.withColumn(name, normalised()).dropDuplicates(["doc_id", name]).drop(name)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
