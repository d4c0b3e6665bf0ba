"""Retention. On plain tables by day: whole days are dropped, the one day past in part is rewritten.

On published runs, over all five tables: what is past retention is first written to a deletion log, which is published
like a run and so takes effect for all tables at once; readers leave out what it names. Compaction rewrites the runs
without these rows, one after the other, and takes the log back last. A crash between any two steps changes nothing
that a reader sees.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.constants import DELETE_AFTER_DAYS
from docpipe.functions.labels import expiry_cutoff
from docpipe.plans.publish import Store
from docpipe.sources.tables import expired_dates, utc_day


def _drop_days(spark: SparkSession, path: str, before: str) -> int:
    """Delete the directories of the days before ``before``; a metadata operation, no data is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("fetched_date=") and name.split("=", 1)[1] < before:
            fs.delete(entry.getPath(), True)
            dropped += 1
    return dropped


def _rewrite_day(rows: DataFrame, kept: DataFrame, path: str, day: str, spark: SparkSession) -> None:
    if kept.isEmpty():
        _drop_day(spark, path, day)
    else:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fetched_date").parquet(path)


def _drop_day(spark: SparkSession, path: str, day: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/fetched_date={day}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def apply_retention(
    spark: SparkSession, records_path: str, chunks_path: str, as_of: datetime, days: int = DELETE_AFTER_DAYS
) -> int:
    """Delete what is past retention; returns the number of deleted records.

    Chunks have the day of their record, so that the same days go in both tables.
    """
    records, chunks = spark.read.parquet(records_path), spark.read.parquet(chunks_path)
    past, boundary = expired_dates(as_of, days)
    cutoff = expiry_cutoff(as_of)
    day = spark.range(1).select(utc_day(cutoff).cast("string")).first()[0]
    deleted = records.filter(past | (boundary & (F.col("fetched_at") < cutoff))).count()

    edge = records.filter(boundary)
    edge_chunks = chunks.filter(boundary)
    kept_chunks = edge_chunks.filter(F.col("created_at") >= cutoff)
    # Records first: after a crash no record points to chunks that are gone.
    if not edge.isEmpty():
        _rewrite_day(edge, edge.filter(F.col("fetched_at") >= cutoff), records_path, day, spark)
    _drop_days(spark, records_path, day)
    if not edge_chunks.isEmpty():
        _rewrite_day(edge_chunks, kept_chunks, chunks_path, day, spark)
    _drop_days(spark, chunks_path, day)
    return deleted


#: Tables of a run, with the column that has the time of the response.
TIMED = {"results": "fetched_at", "records": "fetched_at", "chunks": "created_at", "originals": "fetched_at", "rejects": "fetched_at"}
LOG = "tombstones"


def _aged(store: Store, table: str, run: str | None = None) -> DataFrame:
    """Rows of a table with their run and age column `_time`: when the response came, or, where that cannot be read,
    when its file was written."""
    return store.read(table, ["run", "file_time"], run).withColumn("_time", F.coalesce(TIMED[table], "file_time"))


def expire(store: Store, as_of: datetime, days: int = DELETE_AFTER_DAYS) -> int:
    """Write what is older than ``days`` to the deletion log of ``as_of``; returns the number of responses that are
    logged with it. Nothing is rewritten. Repeating it replaces that log."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    # Every response has a result or a reject, and the text taken from it a record with the same time.
    parts = [_aged(store, t).filter(F.col("_time") < cutoff).select(F.col("run").alias("of_run"), "record_id") for t in ("results", "records", "rejects")]
    old = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    with store.publishing(f"{LOG}-{as_of:%Y%m%dT%H%M%S.%f}") as log:
        return log.write(LOG, old)


def _logged(store: Store) -> DataFrame:
    return store.read(LOG).select(F.col("of_run").alias("run"), "record_id").distinct()


def live(store: Store, table: str, run: str | None = None) -> DataFrame:
    """The rows of a table, of all runs or of one, that no deletion log names.

    A log names a response within its run: one that was fetched again by a later run stays.
    """
    rows = store.read(table, ["run"], run)
    if store.has(LOG):
        rows = rows.join(_logged(store), ["run", "record_id"], "left_anti")
    return rows.drop("run")


def compact(store: Store) -> int:
    """Rewrite the runs that deletion logs name without the logged rows, then take the logs back; returns the number of
    rewritten runs. A row whose time cannot be read gets that of its old file, so that its age goes on.

    Logs that are published meanwhile stay for the next compaction.
    """
    if not store.has(LOG):
        return 0
    logs = [r["run"] for r in store.runs().filter(F.col("schemas")[LOG].isNotNull()).collect()]
    runs = store.runs().select("run", "schemas", "counts").join(_logged(store).select("run").distinct(), "run", "left_semi").collect()
    for run in runs:
        with store.publishing(run["run"]) as attempt:
            for table in TIMED:
                if table in run["schemas"]:
                    kept = _timed(store, table, run["run"])
                    attempt.write(table, kept, "fetched_date" if "fetched_date" in kept.columns else None)
            attempt.counts["inputs"] = attempt.counts.get("results", 0) + attempt.counts.get("rejects", 0)
    for log in logs:
        store.withdraw(log)
    return len(runs)


def _timed(store: Store, table: str, run: str) -> DataFrame:
    columns = store.read(table, run=run).columns
    rows = _aged(store, table, run).join(_logged(store), ["run", "record_id"], "left_anti")
    return rows.withColumn(TIMED[table], F.col("_time")).select(columns)
