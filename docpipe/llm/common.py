"""Tables, written intermediate results and ranks shared by the operators of this folder."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share.

    spark.checkpoint.dir names it; where that is unset, the warehouse is taken, which is shared as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{shared.rstrip('/')}/docpipe-{uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows of df from a table in the shared folder: computed once, and the lineage ends there.

    options are for the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def body(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(column: str = "text") -> Column:
    """Tells rows with one doc_id but different texts apart."""
    return F.xxhash64(body(column))


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs whose keys (column of dropped: expression on docs, nulls equal) are not in dropped."""
    names = {k: fresh(docs, f"_{k}") for k in keys}
    marked = docs.withColumns({names[k]: c for k, c in keys.items()})
    gone = dropped.select(*[F.col(k).alias(f"{names[k]}_gone") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same &= F.col(names[k]).eqNullSafe(F.col(f"{names[k]}_gone"))
    return marked.join(gone, same, "left_anti").drop(*names.values())


def with_rank(df: DataFrame, group: str, order: list[str], rank: str, rows: int) -> DataFrame:
    """Add the gapless rank (from 0) of each row within its group, however large a group is.

    Rows are dealt to cells by a hash of the order columns, ranked within (cell, group), and moved by the number of
    rows in the cells before. No task holds a group; a cell holds about a million rows at most.
    """
    cells = max(1024, -(-rows // 1_000_000))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sizes = dealt.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell", group).orderBy(*order)
    placed = dealt.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
    return placed.join(starts, [group, "_cell"]).withColumn(rank, F.col("_before") + F.col("_in")).drop("_cell", "_before", "_in")
