"""Files of any size as pieces between separators, in order, with sums over all pieces before.

A file is one document, but no row and no task holds it: Spark splits it into blocks, and what is known only from the
start of the file (are we inside quotes? how deep?) is the sum over the blocks before, a row each, plus the sum inside
the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, BLOCK, PLACE = "file", "_block", "_place"
# Four hexadecimal digits tell the pieces of a run apart.
PIECES_PER_RUN = 16_384
BOM = "﻿"


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, _block, _place, piece, file_bytes) and the partition columns of the path.

    What follows the last separator is a piece unless it is empty.
    """
    rows = spark.read.text(path, lineSep=separator)
    parts = [c for c in rows.columns if c != "value"]
    return rows.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(PLACE),
        *parts,
        F.col("value").alias("piece"),
        F.col("_metadata.file_size").alias("file_bytes"),
    )


def runs_of_pieces(pieces: DataFrame, separator: str, size: int = PIECES_PER_RUN) -> DataFrame:
    """The pieces put together to runs of at most ``size`` in the same columns; a run lies within a block.

    The pieces of a run are read by one task. Their order is written before them, as a list needs not keep it.
    """
    parts = [c for c in pieces.columns if c not in (FILE, BLOCK, PLACE, "piece")]
    order = F.lpad(F.hex(F.col(PLACE) % size), 4, "0")
    coded = F.concat(order.cast("binary"), F.col("piece").cast("binary"))
    run = F.expr(f"{PLACE} div {size}")
    runs = pieces.groupBy(FILE, BLOCK, run.alias(PLACE)).agg(*[F.first(c).alias(c) for c in parts], F.sort_array(F.collect_list(coded)).alias("p"))
    text = F.array_join(F.expr("transform(p, b -> cast(substring(b, 5) AS string))"), separator)
    return runs.select(FILE, BLOCK, PLACE, *parts, text.alias("piece"))


def with_sums_before(pieces: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Add sums over all pieces of the file before each piece; a block is the largest group that is sorted."""
    own = {f"_{name}": amount for name, amount in sums.items()}
    valued = pieces.withColumns(own)
    totals = valued.groupBy(FILE, BLOCK).agg(*[F.sum(c).alias(c) for c in own])
    ahead = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(FILE, BLOCK, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_start") for c in own])
    inside = Window.partitionBy(FILE, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    found = {name: F.coalesce(F.sum(f"_{name}").over(inside), F.lit(0)) + F.col(f"_{name}_start") for name in sums}
    return valued.join(starts, [FILE, BLOCK]).withColumns(found).drop(*own, *[f"{c}_start" for c in own])


def file_totals(pieces: DataFrame, width: int = 1) -> DataFrame:
    """(file, n_pieces, closed, bom): whether the file ends with the separator, and whether it starts with a byte order
    mark, which the reader takes away."""
    sizes = pieces.groupBy(FILE).agg(
        F.count("*").alias("n_pieces"), (F.sum(F.octet_length("piece") + width) - F.max("file_bytes")).alias("_over")
    )
    return sizes.select(FILE, "n_pieces", F.col("_over").isin(0, -3).alias("closed"), (F.col("_over") < 0).alias("bom"))


def gathered(pieces: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """Pieces of one record put together in their order; only records of several pieces are shuffled.

    ``pieces`` has the keys, `single` (a record by itself) and `piece`; the result has the keys and `text`.
    """
    alone = pieces.filter("single").select(*keys, F.col("piece").alias("text"))
    several = pieces.filter("NOT single").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(BLOCK, PLACE, "piece"))).alias("p"))
    return alone.unionByName(several.select(*keys, F.array_join(F.col("p.piece"), separator).alias("text")))
