"""Record and chunk rows, and the tables they are written to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.constants import STALE_AFTER_DAYS

RECORD_COLUMNS = ["record_id", "url", "content_type", "fetched_at", "fetched_date"]
CHUNK_ROW_COLUMNS = [
    "record_id", "chunk_index", "key", "title", "content", "size_bytes", "created_at", "expires_at", "fetched_date",
]


def record_id(url: Column, fetched_at: Column) -> Column:
    """Id of a record: the same response gets the same id again, so that a repeated run changes nothing.

    128 bits: with 64, a table of some billion records would have to expect collisions.
    """
    source = F.concat_ws("\x01", url, F.unix_micros(fetched_at).cast("string"))
    return F.substring(F.sha2(source, 256), 1, 32)


def utc_day(time: Column) -> Column:
    """The day in UTC, whatever the zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_micros(time) / 86_400_000_000).cast("int"))


def record_rows(df: DataFrame) -> DataFrame:
    """One metadata row per response; no body."""
    return df.select(
        record_id(F.col("url"), F.col("fetched_at")).alias("record_id"),
        "url",
        "content_type",
        "fetched_at",
        utc_day(F.col("fetched_at")).alias("fetched_date"),
    )


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the chunk table from (record_id, chunk_index, key, title, content, fetched_at)."""
    return chunks.select(
        "record_id",
        "chunk_index",
        "key",
        "title",
        "content",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.col("fetched_at").alias("created_at"),
        (F.col("fetched_at") + F.make_dt_interval(F.lit(STALE_AFTER_DAYS))).alias("expires_at"),
        utc_day(F.col("fetched_at")).alias("fetched_date"),
    )


def write_table(df: DataFrame, path: str, mode: str = "append", cluster: bool = False) -> None:
    """Parquet, one directory per day of fetching.

    Responses mostly arrive day by day, so rows are written where they are, without a shuffle. ``cluster`` is for
    input that mixes many days in every task: a hash on day and record avoids many small files, and even a day that
    holds most of the rows is spread over many tasks.
    """
    if cluster:
        df = df.repartition(F.col("fetched_date"), F.col("record_id"))
    df.write.mode(mode).partitionBy("fetched_date").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def expired_dates(as_of: datetime, days: int) -> tuple[Column, Column]:
    """Conditions on ``fetched_date``: whole days that are past retention, and the one day that is so in part."""
    cutoff = utc_day(F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return F.col("fetched_date") < cutoff, F.col("fetched_date") == cutoff
