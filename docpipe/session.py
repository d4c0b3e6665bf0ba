"""Session settings the jobs rely on, in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Token rows are many times larger than the shuffled documents they come from: keep partitions small.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Large groups in the lookup joins are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Token jobs sort many small groups per task; keep them in the hash map for longer before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.parquet.filterPushdown": "true",
    # The ids of a lookup are compared one by one with Bloom filters and page bounds, not only their range.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "docpipe", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        # Without call-site tracking, large expressions are built several times faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", extra.pop("driver_memory", "8g"))
        .config("spark.sql.shuffle.partitions", extra.pop("shuffle_partitions", "8"))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
