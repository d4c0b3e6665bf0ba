"""Shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_COLUMNS = ["chunk_index", "key", "title", "content"]


# Tells rows with equal keys apart, see by_document.
ROW = "_row"


def by_document(df: DataFrame, keys: Sequence[str], distribute: bool = True) -> DataFrame:
    """Distribute whole documents before they are exploded, and number them.

    Tokens keep the partitioning of the row they come from, so that the windows and groupings that follow need
    no further exchange, and what is shuffled is the document once, not its many times larger token rows.

    The number keeps the tokens of repeated documents apart. It is given after the shuffle and used up in the same
    stage, so that a task that runs again is consistent in itself; it never reaches a result.
    """
    if distribute:
        df = df.repartition(*[F.col(k) for k in keys])
    return df.withColumn(ROW, F.monotonically_increasing_id())


def in_order(keys: Sequence[str], *order: str) -> WindowSpec:
    """Rows of a document from its start up to the current one."""
    return (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def explode_chunks(df: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    """(id, chunk_index, key, title, content) from an array of (key, title, content)."""
    return df.select(id_col, F.posexplode(chunks).alias("chunk_index", "chunk")).select(
        id_col, "chunk_index", "chunk.key", "chunk.title", "chunk.content"
    )
