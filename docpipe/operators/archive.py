"""Archive members: index, readable texts, extraction errors.

``members``: archive_id, entry_index, entry_name, size, is_directory, content (null if it could not be read), and
for an archive that broke off a row with ``failed`` true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.constants import ARCHIVE_TEXT_EXTENSIONS, KEY_CHARS
from docpipe.functions.arrays import ordered_concat
from docpipe.functions.text import trim


def _listed(members: DataFrame) -> DataFrame:
    return members.filter(~F.col("failed")) if "failed" in members.columns else members


def archive_index(members: DataFrame) -> DataFrame:
    """One listing per archive, of names and sizes only."""
    line = F.concat("entry_name", F.lit("  ("), F.col("size").cast("string"), F.lit(" B)"))
    return (
        _listed(members)
        .groupBy("archive_id")
        .agg(F.count("*").alias("n_files"), ordered_concat(F.col("entry_index"), line, "\n").alias("listing"))
        .select(
            "archive_id",
            F.lit("index").alias("key"),
            F.lit("file index").alias("title"),
            F.concat(
                F.lit("Archive contains "), F.col("n_files").cast("string"), F.lit(" files:\n\n"), "listing"
            ).alias("content"),
        )
    )


def is_text_member(entry_name: Column) -> Column:
    """By extension; a name without a dot is its own extension."""
    return F.substring_index(F.lower(entry_name), ".", -1).isin(ARCHIVE_TEXT_EXTENSIONS)


def archive_text_members(members: DataFrame) -> DataFrame:
    return _listed(members).filter(~F.col("is_directory") & is_text_member(F.col("entry_name")))


def member_key(entry_name: Column) -> Column:
    # Without the Unicode flag, ignoring case concerns the letters a to z only.
    key = F.substring(F.regexp_replace(entry_name, "(?i)[^a-z0-9._-]+", "_"), 1, KEY_CHARS)
    return F.when(key == "", "file").otherwise(key)


def archive_member_chunks(members: DataFrame, preview_chars: int | None = None) -> DataFrame:
    """The readable texts, trimmed and whole; empty ones are left out. ``preview_chars`` adds the column ``preview``."""
    chunks = (
        archive_text_members(members)
        .withColumn("trimmed", trim(F.col("content")))
        .filter(F.col("trimmed") != "")
        .select(
            "archive_id",
            "entry_index",
            member_key(F.col("entry_name")).alias("key"),
            F.col("entry_name").alias("title"),
            F.col("trimmed").alias("content"),
        )
    )
    return chunks if preview_chars is None else chunks.withColumn("preview", F.substring("content", 1, preview_chars))


def archive_errors(members: DataFrame) -> DataFrame:
    """One error chunk per archive that broke off. ``lone``: nothing of it could be listed."""
    return (
        members.groupBy("archive_id")
        .agg(F.count_if("failed").alias("n_failed"), F.count_if(~F.col("failed")).alias("n_listed"))
        .filter(F.col("n_failed") > 0)
        .select(
            "archive_id",
            F.lit("error").alias("key"),
            F.lit("extraction error").alias("title"),
            F.lit("Failed to extract archive contents.").alias("content"),
            (F.col("n_listed") == 0).alias("lone"),
        )
    )


def split_archive(members: DataFrame) -> DataFrame:
    """All chunks of the archives in order: index, texts, error. ``chunk_index`` counts within the archive."""
    if "failed" not in members.columns:
        members = members.withColumn("failed", F.lit(False))
    index = archive_index(members).withColumn("entry_index", F.lit(-1).cast("bigint"))
    texts = archive_member_chunks(members)
    errors = archive_errors(members).drop("lone").withColumn("entry_index", F.lit((1 << 62)).cast("bigint"))
    rows = index.unionByName(texts).unionByName(errors)
    # Members may be of any size: only their numbers are sorted, and the content is joined by the unique pair.
    position = F.row_number().over(Window.partitionBy("archive_id").orderBy("entry_index")) - 1
    places = rows.select("archive_id", "entry_index", position.alias("chunk_index"))
    return rows.join(places, ["archive_id", "entry_index"]).select("archive_id", "chunk_index", "key", "title", "content")
