"""Web responses as a table, and what is let through of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.constants import SIZE_LIMIT_BYTES
from docpipe.functions.text import decode_utf8

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)


def stream_responses(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New response files as they arrive."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def declared_length(content_length: Column) -> Column:
    """Leading integer of the header value as text without leading zeros, null if there is none; any number of digits."""
    number = F.regexp_extract(content_length, r"^\s*([+-]?\d+)", 1)
    return F.when(number != "", F.regexp_replace(number, r"^(-?)\+?0*(?=\d)", "$1"))


def size_reject(limit: int | None = SIZE_LIMIT_BYTES) -> Column:
    """Reason to reject a response for its size, null if it is fine (or without limit). The declared length counts first."""
    if limit is None:
        return F.lit(None).cast("string")
    declared = declared_length(F.col("content_length"))
    actual = F.octet_length("body")
    return F.when(
        (F.length(declared) > len(str(limit))) & ~F.startswith(declared, F.lit("-")) | (declared.try_cast("decimal(38,0)") > limit),
        F.concat(F.lit("Download too large: "), declared, F.lit(f" bytes exceeds {limit} byte limit")),
    ).when(
        actual > limit,
        F.concat(F.lit(f"Download exceeded {limit} byte limit after "), actual.cast("string"), F.lit(" bytes")),
    )


def status_reject() -> Column:
    failed = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return F.when(F.col("status").isNull(), "missing status").otherwise(failed)


def body_reject() -> Column:
    return F.when(F.col("body").isNull(), "missing body")


def with_admission(responses: DataFrame, limit: int | None = SIZE_LIMIT_BYTES) -> DataFrame:
    """Adds ``stage`` and ``reason`` of the rejection, null for what is let through."""
    reason = F.coalesce(size_reject(limit), status_reject(), body_reject())
    stage = F.when(size_reject(limit).isNotNull(), "size").when(status_reject().isNotNull(), "status").when(body_reject().isNotNull(), "body")
    return responses.withColumns({"stage": stage, "reason": reason})


def admitted(responses: DataFrame, limit: int | None = SIZE_LIMIT_BYTES) -> DataFrame:
    """Responses to process. The status test reaches the Parquet scan."""
    return responses.filter((F.col("status") < 400) & F.col("body").isNotNull() & size_reject(limit).isNull())


def rejected(responses: DataFrame, limit: int | None = SIZE_LIMIT_BYTES) -> DataFrame:
    return with_admission(responses, limit).filter(F.col("stage").isNotNull()).select("url", "stage", "reason")


def raw_bodies(responses: DataFrame, limit: int | None = SIZE_LIMIT_BYTES) -> DataFrame:
    """Bodies without any conversion."""
    return admitted(responses, limit).select("url", "body")


def with_text(responses: DataFrame) -> DataFrame:
    return responses.withColumn("text", decode_utf8(F.col("body")))
