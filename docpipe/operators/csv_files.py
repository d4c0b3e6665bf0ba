"""CSV documents that are files of any size: records, cells, row groups. The results are those of `csv_cells` on the
whole text, but a file is read by many tasks, and no row holds more than a record or a group of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.constants import CSV_GROUP_ROWS, CSV_INLINE_ROWS
from docpipe.functions import csv as C
from docpipe.functions.arrays import ordered_concat
from docpipe.functions.text import decode_utf8
from docpipe.sources.pieces import BLOCK, BOM, FILE, PLACE, file_totals, gathered, read_pieces, with_sums_before


def csv_file_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, partition columns, row_idx, fields). A line belongs to the record that is open at its start: one that
    has an odd number of quotes before it continues the record, any other starts one."""
    lines = read_pieces(spark, path, "\n")
    parts = [c for c in lines.columns if c not in (FILE, BLOCK, PLACE, "piece", "file_bytes")]
    quotes = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit('"'), F.lit("")))
    odd = quotes % 2
    open_ = with_sums_before(lines.withColumn("odd", odd), {"before": F.col("odd")})
    open_ = open_.withColumn("starts", (F.col("before") % 2 == 0).cast("int"))
    numbered = with_sums_before(open_, {"records": F.col("starts")})
    # A line that continues a record belongs to the last one started.
    row = F.col("records") + F.col("starts") - 1
    single = (F.col("starts") == 1) & (F.col("odd") == 0)
    keyed = numbered.select(FILE, *parts, row.cast("int").alias("row_idx"), single.alias("single"), BLOCK, PLACE, "piece")
    records = gathered(keyed, [FILE, *parts, "row_idx"], "\n")
    last = open_.groupBy(FILE).agg((F.sum("starts") - 1).alias("last"), (F.sum("odd") % 2 == 1).alias("unclosed"))
    ends = file_totals(lines).join(last, FILE).select(FILE, "closed", "bom", "last", "unclosed")
    records = records.join(ends, FILE)
    is_last = F.col("row_idx") == F.col("last")
    text = F.when(F.col("bom") & (F.col("row_idx") == 0), F.concat(F.lit(BOM), "text")).otherwise(F.col("text"))
    # A quote that is never closed runs to the end of the file, a final line break included.
    text = F.when(is_last & F.col("unclosed") & F.col("closed"), F.concat(text, F.lit("\n"))).otherwise(text)
    records = records.withColumn("fields", C.csv_fields(decode_utf8(text.cast("binary"))))
    ended = F.col("closed") & ~F.col("unclosed")
    return records.filter(~is_last | ended | ~C.is_phantom(F.col("fields"))).select(FILE, *parts, "row_idx", "fields")


def csv_file_cells(spark: SparkSession, path: str) -> DataFrame:
    records = csv_file_records(spark, path)
    return records.select(*[c for c in records.columns if c != "fields"], F.posexplode("fields").alias("col_idx", "value"))


def csv_file_groups(records: DataFrame, inline_rows: int = CSV_INLINE_ROWS, group_rows: int = CSV_GROUP_ROWS) -> DataFrame:
    """(file, partition columns, chunk_index, key, title, content) of the long files, from `csv_file_records`.

    Each group repeats the header and the divider; rows are as wide as the widest of the file.
    """
    keys = [c for c in records.columns if c not in ("row_idx", "fields")]
    shape = records.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.max(F.size("fields")).alias("width"), F.max(F.when(F.col("row_idx") == 0, F.col("fields"))).alias("header")
    )
    long = shape.filter(F.col("rows") > inline_rows)
    head = F.array_join(F.array(C.row_line(F.col("header"), F.col("width")), C.divider(F.col("header"))), "\n")
    long = long.select(*keys, "rows", "width", head.alias("head"))
    data = records.filter(F.col("row_idx") > 0).join(long, keys)
    data = data.withColumn("chunk_index", F.floor((F.col("row_idx") - 1) / group_rows).cast("int"))
    line = F.concat(F.lit("\n"), C.row_line(F.col("fields"), F.col("width")))
    groups = data.groupBy(*keys, "chunk_index").agg(
        F.min("row_idx").cast("string").alias("s"), F.max("row_idx").cast("string").alias("e"), F.first("head").alias("head"),
        ordered_concat(F.col("row_idx"), line).alias("lines"),
    )
    return groups.select(
        *keys, "chunk_index", F.concat_ws("_", F.lit("rows"), "s", "e").alias("key"), F.concat(F.lit("rows "), "s", F.lit("-"), "e").alias("title"),
        F.concat("head", "lines").alias("content"),
    )
