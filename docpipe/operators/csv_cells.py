"""CSV documents: cells, shape, Markdown table, row groups. Every operator works inside its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.constants import CSV_GROUP_ROWS, CSV_INLINE_ROWS
from docpipe.functions import csv as C
from docpipe.functions.arrays import let
from docpipe.functions.text import trim_long
from docpipe.operators.common import explode_chunks


def csv_records(df: DataFrame, id_col: str = "doc_id", csv_col: str = "csv") -> DataFrame:
    """One row per record with its fields. Records are exploded first and parsed one by one."""
    records = df.select(id_col, C.csv_records(F.col(csv_col)).alias("records"))
    return (
        records.select(id_col, F.size("records").alias("n"), F.posexplode("records").alias("row_idx", "record"))
        .select(id_col, "n", "row_idx", C.csv_fields(F.col("record")).alias("fields"))
        .filter((F.col("row_idx") < F.col("n") - 1) | ~C.is_phantom(F.col("fields")))
        .select(id_col, "row_idx", "fields")
    )


def csv_cells(df: DataFrame, id_col: str = "doc_id", csv_col: str = "csv") -> DataFrame:
    """One row per cell."""
    return csv_records(df, id_col, csv_col).select(
        id_col, "row_idx", F.posexplode("fields").alias("col_idx", "value")
    )


def csv_shape(df: DataFrame, id_col: str = "doc_id", csv_col: str = "csv") -> DataFrame:
    """Rows, widest row and header width of every document; zeros for an empty one."""
    shape = let(
        C.csv_rows(F.col(csv_col)),
        lambda rows: F.struct(
            F.size(rows).alias("n_rows"),
            C.csv_width(rows).alias("n_cols"),
            F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)).alias("header_cols"),
        ),
    )
    return df.select(id_col, shape.alias("shape")).select(id_col, "shape.*")


def csv_to_markdown(df: DataFrame, id_col: str = "doc_id", csv_col: str = "csv") -> DataFrame:
    """The whole document, trimmed, as a Markdown table."""
    trimmed = let(F.col(csv_col), trim_long)
    return df.select(id_col, C.markdown_table(C.csv_rows(trimmed)).alias("markdown"))


def split_csv(
    df: DataFrame,
    id_col: str = "doc_id",
    csv_col: str = "csv",
    inline_rows: int = CSV_INLINE_ROWS,
    group_rows: int = CSV_GROUP_ROWS,
) -> DataFrame:
    """Row groups of the long documents; short ones have none."""
    return explode_chunks(df, id_col, C.row_groups(C.csv_rows(F.col(csv_col)), inline_rows, group_rows))
