"""Plain text: lines, headings, sections, chunks. Every operator works inside its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.constants import INLINE_LIMIT_BYTES, MIN_SECTION_CHARS
from docpipe.functions import text as T
from docpipe.functions.arrays import let
from docpipe.operators.common import explode_chunks


def text_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line, trailing empty lines included."""
    return df.select(id_col, F.posexplode(T.lines(F.col(text_col))).alias("line_no", "line"))


def text_headings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The heading lines with their positions."""
    return (
        text_lines(df, id_col, text_col)
        .withColumn("heading", T.trim(F.col("line")))
        .filter(T.is_heading(F.col("heading")))
        .select(id_col, "line_no", "heading")
    )


def text_sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections between headings, before small ones are merged."""
    return explode_chunks(df, id_col, T.text_sections(F.col(text_col)))


def text_paragraphs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of the texts in which no section has content."""
    text = F.col(text_col)
    found = let(T.text_sections(text), lambda s: F.when(F.size(s) == 0, T.text_paragraphs(text)))
    return explode_chunks(df, id_col, found)


def split_text(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_SECTION_CHARS,
) -> DataFrame:
    """Chunks of a text: merged sections, or paragraphs if there is none."""
    return explode_chunks(df, id_col, T.text_chunks(F.col(text_col), min_chars))


def section_files(chunks: DataFrame) -> DataFrame:
    """Adds the file name under which a text section is known."""
    return chunks.withColumn("filename", F.format_string("section_%02d.md", "chunk_index"))


def text_fallback(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = INLINE_LIMIT_BYTES
) -> DataFrame:
    """Text of no known kind: inline if small, a single chunk ``content`` otherwise."""
    large = T.is_large(F.col(text_col), limit)
    return df.select(
        id_col,
        F.lit("text").alias("type"),
        (~large).alias("inline"),
        F.when(large, "").otherwise(F.col(text_col)).alias("data"),
        F.when(large, "content").alias("key"),
        F.when(large, "content").alias("title"),
        F.when(large, F.col(text_col)).alias("content"),
    )


def pdf_text_outcomes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What became of the text of a PDF: ``failed``, ``blank`` or ``text``; the first two get a placeholder."""
    text = F.col(text_col)
    outcome = F.when(text.isNull(), "failed").when(T.is_blank(text), "blank").otherwise("text")
    return df.withColumn("outcome", outcome).select(
        id_col,
        "outcome",
        F.when(F.col("outcome") != "text", "document").alias("key"),
        F.when(F.col("outcome") != "text", "original pdf").alias("title"),
        F.when(F.col("outcome") == "failed", "PDF text extraction failed")
        .when(F.col("outcome") == "blank", "PDF contains no extractable text")
        .alias("content"),
    )
