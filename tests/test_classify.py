import pytest
from pyspark.sql import functions as F

from docpipe.functions.classify import content_kind, is_binary, url_extension


@pytest.mark.parametrize(
    "header, url, kind",
    [
        ("text/html; charset=utf-8", None, "html"),
        ("TEXT/HTML", None, "html"),
        ("application/pdf", None, "pdf"),
        ("application/json", None, "json"),
        ("text/csv", None, "csv"),
        ("application/gzip", None, "zip"),
        ("application/x-tar", None, "zip"),
        ("application/octet-stream", None, "unknown"),
        (None, None, "unknown"),
        (None, "", "unknown"),
        (None, "https://x.org/report.pdf", "pdf"),
        ("application/octet-stream", "https://x.org/report.PDF?x=1#y", "pdf"),
        ("application/octet-stream", "https://x.org/a.tgz", "zip"),
        ("application/octet-stream", "https://x.org/a.json", "json"),
        ("text/plain", "https://x.org/a.csv", "csv"),
        ("", "https://x.org/a.htm", "html"),
        (None, "http://site.zip", "zip"),
        (None, "https://x.org/a.json#b?c", "json"),
        ("text/html", "https://x.org/a.pdf", "html"),
    ],
)
def test_kind(spark, header, url, kind):
    row = spark.range(1).select(content_kind(F.lit(header).cast("string"), F.lit(url).cast("string")).alias("k")).first()
    assert row.k == kind


def test_extension(apply):
    urls = ["https://host.example.com/en/1", "http://a/b.Pdf", "nodot", "a.b?c.d", "a#b.c"]
    assert apply(urls, url_extension(F.col("v"))) == ["com/en/1", "pdf", "nodot", "b", "a"]


def test_binary(apply):
    headers = ["image/png", "Audio/x", "video/mp4", "application/octet-stream", "application/pdf", "text/plain", None]
    assert apply(headers, is_binary(F.col("v"))) == [True] * 5 + [False, False]
