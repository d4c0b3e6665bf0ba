"""Content kind of a response from its header and URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import BINARY_HEADERS, EXTENSION_KINDS, HEADER_KINDS, OCTET_STREAM_EXTENSION_KINDS


def url_extension(url: Column) -> Column:
    """Text after the last dot of the URL, query and fragment removed; the whole URL if there is no dot."""
    return F.substring_index(F.regexp_extract(F.lower(url), "^[^?#]*", 0), ".", -1)


def _by_extension(extension: Column, kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind in dict.fromkeys(kinds.values()):
        known = [ext for ext, k in kinds.items() if k == kind]
        out = F.when(extension.isin(known), kind).otherwise(out)
    return out


def content_kind(content_type: Column, url: Column) -> Column:
    """One of html, pdf, json, csv, zip, unknown."""
    header = F.lower(content_type)
    rules = F.lit(None).cast("string")
    for text, kind in reversed(HEADER_KINDS):
        rules = F.when(F.contains(header, F.lit(text)), kind).otherwise(rules)
    extension = url_extension(url)
    octet = F.when(
        F.contains(header, F.lit("application/octet-stream")),
        _by_extension(extension, OCTET_STREAM_EXTENSION_KINDS),
    )
    return F.coalesce(rules, octet, _by_extension(extension, EXTENSION_KINDS), F.lit("unknown"))


def is_binary(content_type: Column) -> Column:
    header = F.lower(content_type)
    found = F.lit(False)
    for text in BINARY_HEADERS:
        found = found | F.contains(header, F.lit(text))
    return F.coalesce(found, F.lit(False))
