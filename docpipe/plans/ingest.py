"""The ingest job: responses in; results, records, chunks, originals and rejects out, all as tables.

Steps that several others read are written first, to the work folder, and read back: that cuts lineage in a way that
survives the loss of executors. The work folder is removed when the tables are written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docpipe.constants import INLINE_LIMIT_BYTES, SIZE_LIMIT_BYTES
from docpipe.plans.publish import Store
from docpipe.plans.route import classify, convert_html, route
from docpipe.sources.responses import with_admission
from docpipe.sources.tables import chunk_rows, utc_day, write_table


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names, or below the warehouse if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Tables:
    """Where the job writes."""

    base: str

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"


def stage(classified: DataFrame, path: str) -> DataFrame:
    """Classified responses as a table partitioned by kind: one pass over the bodies, no shuffle."""
    classified.write.mode("overwrite").partitionBy("kind").parquet(path)
    return classified.sparkSession.read.schema(classified.schema).parquet(path)


def staged_conversion(staged: DataFrame, path: str) -> DataFrame:
    """The Markdown of the staged HTML, written and read back."""
    convert_html(staged).write.mode("overwrite").parquet(path)
    return staged.sparkSession.read.parquet(path)


REJECTED = "rejected"


def stage_all(responses: DataFrame, path: str, size_limit: int | None = SIZE_LIMIT_BYTES) -> tuple[DataFrame, int]:
    """All responses as a table partitioned by kind, and their number: the one pass over the bodies of a job.

    What is not let through has the kind `rejected`, its stage and reason, and no body.
    """
    judged = with_admission(responses, size_limit)
    out = F.col("stage").isNotNull()
    rows = classify(judged, keep=["stage", "reason"])
    rows = rows.withColumns({"kind": F.when(out, REJECTED).otherwise(F.col("kind")), "body": F.when(~out, F.col("body")), "pdf_text": F.when(~out, F.col("pdf_text"))})
    seen = Observation()
    staged = stage(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return staged, int(seen.get["n"])


def outputs(staged: DataFrame, work: str, members: DataFrame | None, force_inline: bool, limit: int) -> dict[str, DataFrame]:
    """The five tables from what `stage_all` wrote. None of them reads the responses again."""
    converted = staged_conversion(staged, f"{work}/converted")
    routed = route(staged, converted, members, force_inline, limit)
    rejects = staged.filter(F.col("kind") == REJECTED).select("record_id", "fetched_at", "url", "stage", "reason")
    return {
        "results": routed.results.select("doc.*", "url", "type", "inline", "data"),
        "chunks": chunk_rows(routed.chunks.select("doc.*", "chunk_index", "key", "title", "content")),
        "records": routed.records.select("doc.record_id", "url", "content_type", "doc.fetched_at", utc_day(F.col("doc.fetched_at")).alias("fetched_date")),
        "originals": routed.originals.select("doc.*", "key", "filename", "body"),
        "rejects": rejects.unionByName(routed.rejects.select("doc.*", "url", "stage", "reason")),
    }


#: Tables with a folder per day.
DAILY = ("chunks", "records")


def publish_ingest(
    responses: DataFrame,
    base: str,
    run: str,
    members: DataFrame | None = None,
    force_inline: bool = False,
    limit: int = INLINE_LIMIT_BYTES,
    size_limit: int | None = SIZE_LIMIT_BYTES,
) -> Store:
    """Ingest responses as the run `run`: its five tables are published together, and replace those of an earlier run
    of that name. Every response must end in results or rejects, once; otherwise nothing is published."""
    spark = responses.sparkSession
    store, work = Store(spark, base), work_dir(spark, "ingest")
    with store.publishing(run) as attempt:
        staged, inputs = stage_all(responses, f"{work}/staged", size_limit)
        attempt.counts["inputs"] = inputs
        for name, rows in outputs(staged, work, members, force_inline, limit).items():
            attempt.write(name, rows, "fetched_date" if name in DAILY else None)
        if inputs != attempt.counts["results"] + attempt.counts["rejects"]:
            raise RuntimeError(f"{inputs} responses gave {attempt.counts['results']} results and {attempt.counts['rejects']} rejects")
    _remove(spark, work)
    return store


def run_ingest(
    responses: DataFrame,
    out: str,
    members: DataFrame | None = None,
    force_inline: bool = False,
    limit: int = INLINE_LIMIT_BYTES,
    size_limit: int | None = SIZE_LIMIT_BYTES,
    mode: str = "append",
) -> Tables:
    """Write the five tables to plain folders. Rows are appended whatever was there; `publish_ingest` can be repeated."""
    spark = responses.sparkSession
    tables = Tables(out)
    work = work_dir(spark, "ingest")
    staged, _ = stage_all(responses, f"{work}/staged", size_limit)
    for name, rows in outputs(staged, work, members, force_inline, limit).items():
        if name in DAILY:
            write_table(rows, tables.path(name), mode)
        else:
            rows.write.mode(mode).parquet(tables.path(name))
    _remove(spark, work)
    return tables
