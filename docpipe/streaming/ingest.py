"""Ingest of responses as their files arrive.

Every response is handled on its own, so the stream keeps no state: a micro-batch goes through the same functions as
a batch job. A batch is written to its own partition, of its stream, and overwrites it: a repeated
batch changes nothing, and a new checkpoint (which counts from 0 again) touches nothing of an earlier stream.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docpipe.plans.ingest import publish_ingest


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that a checkpoint belongs to; a new checkpoint gets a new one, kept beside it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}.stream")
    started = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and fs.exists(started):
        return fs.listStatus(path)[0].getPath().getName()
    fs.delete(path, True)
    name = uuid4().hex
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, name))
    return name


def write_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Run ``transform`` on all available input, batch by batch, and write the rows to ``out``."""

    name = _stream_id(stream.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/stream={name}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_ingest(
    stream: DataFrame, base: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **options
) -> StreamingQuery:
    """Ingest responses as they arrive: every micro-batch is a published run of all five tables.

    The run is named after the stream and the batch, so that a batch that is repeated after a failure replaces what it
    may have published before. ``prepare`` makes responses of the rows of a batch, ``options`` go to `publish_ingest`.
    """
    name = _stream_id(stream.sparkSession, checkpoint)

    def publish(batch: DataFrame, batch_id: int) -> None:
        publish_ingest(prepare(batch) if prepare else batch, base, f"{name}-{batch_id:019d}", **options)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
