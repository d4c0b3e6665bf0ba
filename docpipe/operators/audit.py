"""Text audit: byte order marks, line ends, broken UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.constants import (
    AUDIT_ROOT_EXTENSIONS,
    AUDIT_SCAN_DIRS,
    AUDIT_SKIP_EXTENSIONS,
    AUDIT_SKIP_NAMES,
)
from docpipe.functions.text import decode_utf8


def audit_candidates(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files to scan: those in the scanned directories, and some at the top level; skipped names nowhere."""
    path = F.col(path_col)
    parts = F.split(path, "/")

    # Extension of a name from its last dot on; a leading dot alone makes no extension.
    def ext(name):
        return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))

    skipped = F.exists(parts, lambda name: name.isin(AUDIT_SKIP_NAMES) | ext(name).isin(AUDIT_SKIP_EXTENSIONS))
    nested = (F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(AUDIT_SCAN_DIRS)
    top = (F.size(parts) == 1) & ext(path).isin(AUDIT_ROOT_EXTENSIONS)
    return files.filter((nested | top) & ~skipped)


def encoding_issues(files: DataFrame, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """One row per document: BOM, first line that ends with CR LF, malformed UTF-8, and how many issues that is."""
    body = F.col(body_col)
    text = decode_utf8(body)
    # Only a CR followed by a line break makes the text count as having CR LF lines.
    crlf = F.when(
        F.contains(text, F.lit("\r\n")),
        F.array_position(F.transform(F.split(text, "\n", -1), lambda line: F.endswith(line, F.lit("\r"))), True),
    )
    issues = files.select(
        id_col,
        F.startswith(body, F.unhex(F.lit("EFBBBF"))).alias("has_bom"),
        crlf.alias("crlf_line"),
        (~F.is_valid_utf8(body.cast("string"))).alias("malformed"),
    )
    n = (
        F.col("has_bom").cast("bigint")
        + F.col("crlf_line").isNotNull().cast("bigint")
        + F.col("malformed").cast("bigint")
    )
    return issues.withColumn("n_issues", n)


def encoding_report(files: DataFrame, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    return encoding_issues(files, id_col, body_col).agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("n_issues") > 0).alias("n_files_with_issues"),
        F.coalesce(F.sum("n_issues"), F.lit(0)).alias("n_issues"),
        (F.coalesce(F.sum("n_issues"), F.lit(0)) == 0).alias("passed"),
    )
