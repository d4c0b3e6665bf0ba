"""From documents to packed training sequences: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it again as the next stage's docs. All stages but the last return the columns of docs, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm import exact_dedup, minhash, packing, pii, quality_rules
from docpipe.llm.common import table, text_hash, without, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules of documents and hosts keep. Null and empty texts go."""
    judged = quality_rules.quality_rules(docs)
    keys = {"doc_id": F.col("doc_id"), "text_hash": text_hash(), "host": F.col("source").cast("string")}
    return without(docs, judged.filter(~F.col("kept")), keys)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), that with the smallest doc_id."""
    found = minhash.near_duplicates(docs)
    return without(docs, found.filter(~F.col("kept")), {"doc_id": F.col("doc_id"), "text_hash": text_hash()})


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets, and n_chars (where docs has it) counted again."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash", near),
    ("pii", private),
    ("packing", pack),
]

#: SQL cannot express the packing; tests/llm/test_pipeline.py compares every stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
