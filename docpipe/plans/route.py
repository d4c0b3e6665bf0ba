"""From classified responses to results, records, chunks, originals and rejects.

A document is identified by the struct ``doc`` (record_id, fetched_at) in all branches, so that chunk rows have
their time without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.constants import INLINE_LIMIT_BYTES
from docpipe.functions import csv as C
from docpipe.functions.arrays import let
from docpipe.functions.classify import content_kind, is_binary
from docpipe.functions.text import decode_utf8, is_large, text_chunks, trim_long
from docpipe.operators.archive import split_archive
from docpipe.operators.common import explode_chunks
from docpipe.operators.html import html_section_markdown, html_to_markdown
from docpipe.operators.json_tokens import json_pretty, json_valid, split_json
from docpipe.operators.text import pdf_text_outcomes
from docpipe.sources.tables import record_id

STAGED_COLUMNS = ["record_id", "url", "content_type", "fetched_at", "body", "pdf_text", "body_bytes", "is_binary", "kind"]
PDF_PREFIX, ZIP_PREFIX = "pdf:text:", "zip:contents:"


@dataclass(frozen=True)
class Routed:
    """``results``: doc, url, type, inline, data. ``chunks``: doc and the chunk columns. ``records``: doc, url,
    content_type. ``originals``: doc, key, filename, body. ``rejects``: doc, url, stage, reason."""

    results: DataFrame
    chunks: DataFrame
    records: DataFrame
    originals: DataFrame
    rejects: DataFrame


def classify(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Adds id, kind and size, and keeps the columns ``keep``. The extracted text of PDFs comes with the responses as
    ``pdf_text``, if at all."""
    if "pdf_text" not in responses.columns:
        responses = responses.withColumn("pdf_text", F.lit(None).cast("string"))
    url = F.coalesce("url", F.lit("(unknown)"))
    return responses.select(
        record_id(url, F.col("fetched_at")).alias("record_id"),
        url.alias("url"),
        "content_type",
        "fetched_at",
        "body",
        "pdf_text",
        F.octet_length("body").cast("bigint").alias("body_bytes"),
        is_binary(F.col("content_type")).alias("is_binary"),
        content_kind(F.col("content_type"), F.col("url")).alias("kind"),
        *keep,
    )


def _doc(record: Column | str = "record_id") -> Column:
    record = F.col(record) if isinstance(record, str) else record
    return F.struct(record.alias("record_id"), F.col("fetched_at"))


def _derived_doc(prefix: str) -> Column:
    return _doc(record_id(F.concat(F.lit(prefix), F.col("url")), F.col("fetched_at")))


def _of_kind(staged: DataFrame, kind: str) -> DataFrame:
    return staged.filter(F.col("kind") == kind).select(
        _doc().alias("doc"), "url", "fetched_at", "content_type", "body", "pdf_text", "is_binary"
    )


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "url", decode_utf8(F.col("body")).alias("text"))


def _results(df: DataFrame, type_: str, inline: Column, data: Column, force_inline: bool = False) -> DataFrame:
    shown = data if force_inline else F.when(inline, data).otherwise("")
    return df.select("doc", "url", F.lit(type_).alias("type"), inline.alias("inline"), shown.alias("data"))


def _records(df: DataFrame, content_type: str | Column, doc: str = "doc", url: Column | None = None) -> DataFrame:
    content_type = F.lit(content_type) if isinstance(content_type, str) else content_type
    url = F.col("url") if url is None else url
    return df.select(F.col(doc).alias("doc"), url.alias("url"), content_type.alias("content_type"))


def _originals(df: DataFrame, key: str, filename: str) -> DataFrame:
    return df.select("doc", F.lit(key).alias("key"), F.lit(filename).alias("filename"), "body")


def convert_html(staged: DataFrame) -> DataFrame:
    """Markdown of the HTML responses. Write it before routing: it decides what is split, and is returned as well."""
    docs = _with_text(_of_kind(staged, "html"))
    # The URL rides along in the key; it is functionally dependent on the document.
    return html_to_markdown(docs, ["doc", "url"], "text")


def route_html(staged: DataFrame, converted: DataFrame, force_inline: bool, limit: int):
    large = is_large(F.col("markdown"), limit)
    big = converted.filter(large)
    docs = _with_text(_of_kind(staged, "html")).join(big.select("doc"), "doc", "left_semi")
    return (
        _results(converted, "markdown", ~large, F.col("markdown"), force_inline),
        html_section_markdown(docs, "doc", "text"),
        _records(big, "text/html"),
    )


def route_json(staged: DataFrame, force_inline: bool, limit: int):
    docs = _with_text(_of_kind(staged, "json"))
    large = is_large(F.col("text"), limit)
    small, big = docs.filter(~large), docs.filter(large)
    urls = F.struct("doc", "url").alias("source")
    pretty = json_pretty((docs if force_inline else small).select(urls, "text", large.alias("large")), "source", "text")
    pretty = pretty.select("source.*", "valid", "pretty")
    checked = json_valid(big.select(urls, "text"), "source", "text").select("source.*", "valid")
    if force_inline:
        # Everything is converted; what is large keeps its flag.
        big_ids = big.select("doc").withColumn("large", F.lit(True))
        shown = pretty.filter("valid").join(big_ids, "doc", "left")
        results = _results(shown, "json", F.col("large").isNull(), F.col("pretty"), True)
        invalid = pretty.filter(~F.col("valid"))
    else:
        results = _results(pretty.filter("valid"), "json", F.lit(True), F.col("pretty")).unionByName(
            _results(checked.filter("valid"), "json", F.lit(False), F.lit(""))
        )
        invalid = pretty.filter(~F.col("valid")).select("doc", "url").unionByName(checked.filter(~F.col("valid")).select("doc", "url"))
    rejects = invalid.select("doc", "url", F.lit("convert").alias("stage"), F.lit("invalid JSON").alias("reason"))
    return results, split_json(big, "doc", "text"), _records(checked.filter("valid"), "application/json"), rejects


def route_csv(staged: DataFrame, force_inline: bool):
    docs = _with_text(_of_kind(staged, "csv"))
    groups = C.row_groups(C.csv_rows(F.col("text")))
    inline = groups.isNull()
    table = C.markdown_table(C.csv_rows(let(F.col("text"), trim_long)))
    # Counting the rows does not need the table, and the table is made only where it is shown.
    return (
        _results(docs, "csv", inline, table, force_inline),
        explode_chunks(docs, "doc", groups),
        _records(docs.filter(~inline), "text/csv"),
    )


def route_pdf(staged: DataFrame):
    docs = _of_kind(staged, "pdf").withColumn("text_doc", _derived_doc(PDF_PREFIX))
    outcome = F.col("outcome")
    outcomes = pdf_text_outcomes(docs.withColumn("meta", F.struct("doc", "url", "text_doc", "pdf_text")), "meta", "pdf_text")
    readable = outcomes.filter(outcome == "text").select("meta.*")
    results = _results(docs, "pdf", F.lit(False), F.lit(""))
    chunks = explode_chunks(readable, "text_doc", text_chunks(F.col("pdf_text"))).withColumnRenamed("text_doc", "doc")
    records = _records(docs, "application/pdf").unionByName(
        _records(readable, "text/markdown", "text_doc", F.concat(F.lit(PDF_PREFIX), "url"))
    )
    return results, chunks, records, _originals(docs, "document", "document.pdf")


def route_zip(staged: DataFrame, members: DataFrame | None):
    """``members``: rows of operators.archive with ``archive_id`` = record_id. Without any, extraction has failed."""
    docs = _of_kind(staged, "zip").withColumn("text_doc", _derived_doc(ZIP_PREFIX))
    results = _results(docs, "zip", F.lit(False), F.lit(""))
    records, originals = _records(docs, "application/zip"), _originals(docs, "archive", "archive.zip")
    if members is None:
        return results, None, records, originals
    chunks = split_archive(members)
    # Only an archive of which something could be listed gets a record for its texts; that is its index chunk.
    ids = docs.select(F.col("doc.record_id").alias("archive_id"), "text_doc", "url")
    listed = ids.join(chunks.filter(F.col("key") == "index").filter(F.col("chunk_index") == 0).select("archive_id"), "archive_id", "left_semi")
    records = records.unionByName(_records(listed, "text/plain", "text_doc", F.concat(F.lit(ZIP_PREFIX), "url")))
    chunks = chunks.join(listed.select("archive_id", F.col("text_doc").alias("doc")), "archive_id").drop("archive_id")
    return results, chunks, records, originals


def route_other(staged: DataFrame, force_inline: bool, limit: int):
    docs = _of_kind(staged, "unknown")
    binary = docs.filter("is_binary")
    texts = _with_text(docs.filter(~F.col("is_binary")))
    large = is_large(F.col("text"), limit)
    results = _results(texts, "text", ~large, F.col("text"), force_inline).unionByName(
        _results(binary, "binary", F.lit(False), F.lit(""))
    )
    chunks = texts.filter(large).select(
        "doc",
        F.lit(0).alias("chunk_index"),
        F.lit("content").alias("key"),
        F.lit("content").alias("title"),
        F.col("text").alias("content"),
    )
    records = _records(texts.filter(large), "text/plain").unionByName(_records(binary, F.col("content_type")))
    return results, chunks, records, _originals(binary, "file", "file.bin")


def route(
    staged: DataFrame,
    converted: DataFrame | None = None,
    members: DataFrame | None = None,
    force_inline: bool = False,
    limit: int = INLINE_LIMIT_BYTES,
) -> Routed:
    """All branches united. ``staged`` comes from ``classify``; if it is a table partitioned by kind, every branch
    reads its own part of it. ``converted`` is ``convert_html(staged)``, ideally read back from where it was written.
    """
    converted = convert_html(staged) if converted is None else converted
    html, html_chunks, html_records = route_html(staged, converted, force_inline, limit)
    json, json_chunks, json_records, json_rejects = route_json(staged, force_inline, limit)
    csv, csv_chunks, csv_records = route_csv(staged, force_inline)
    pdf, pdf_chunks, pdf_records, pdf_originals = route_pdf(staged)
    zip_, zip_chunks, zip_records, zip_originals = route_zip(staged, members)
    other, other_chunks, other_records, other_originals = route_other(staged, force_inline, limit)

    def union(*parts: DataFrame | None) -> DataFrame:
        first, *rest = [p for p in parts if p is not None]
        for part in rest:
            first = first.unionByName(part)
        return first

    return Routed(
        results=union(html, json, csv, pdf, zip_, other),
        chunks=union(html_chunks, json_chunks, csv_chunks, pdf_chunks, zip_chunks, other_chunks),
        records=union(html_records, json_records, csv_records, pdf_records, zip_records, other_records),
        originals=union(pdf_originals, zip_originals, other_originals),
        rejects=json_rejects,
    )


def kind_histogram(staged: DataFrame, limit: int = INLINE_LIMIT_BYTES) -> DataFrame:
    """Documents, bytes and share of small bodies per kind."""
    small = F.count_if(F.col("body_bytes") <= limit)
    return staged.groupBy("kind").agg(
        F.count("*").alias("n_docs"),
        F.sum("body_bytes").alias("total_bytes"),
        F.max("body_bytes").alias("max_bytes"),
        small.alias("n_small"),
        F.round(small / F.count("*"), 4).alias("small_share"),
    )


def binary_originals(staged: DataFrame) -> DataFrame:
    """What is kept as it came: PDFs, archives, and other binary bodies."""
    kind = F.col("kind")
    kept = staged.filter(kind.isin("pdf", "zip") | ((kind == "unknown") & F.col("is_binary")))
    return kept.select(
        "record_id",
        "url",
        F.when(kind == "pdf", "document").when(kind == "zip", "archive").otherwise("file").alias("key"),
        F.when(kind == "pdf", "document.pdf").when(kind == "zip", "archive.zip").otherwise("file.bin").alias("filename"),
        "body",
    )
