import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docpipe.operators import html as H
from docpipe.operators import json_tokens as J
from docpipe.constants import SIZE_LIMIT_BYTES
from docpipe.plans.ingest import run_ingest
from docpipe.plans.route import classify, route
from docpipe.sources import responses as S
from docpipe.sources.tables import record_id, utc_day
from docpipe.streaming.ingest import write_batches

AT = datetime(2024, 1, 1, 10)
ROWS = [
    ("http://a/1", 200, "text/html", None, b"<h1>Hi</h1><p>x</p>"),
    ("http://a/2", 404, "text/html", None, b"x"),
    ("http://a/3", 200, "application/json", None, b'{"a":[1,2]}'),
    ("http://a/4", 200, "application/json", None, b'{"a":'),
    ("http://a/5", 200, "application/json", None, json.dumps({f"k{i}": "x" * 10_000 for i in range(10)}).encode()),
    ("http://a/6.pdf", 200, None, None, b"%PDF"),
    ("http://a/7.zip", 200, None, None, b"PK"),
    ("http://a/8", 200, "text/csv", None, ("h,i\n" + "1,2\n" * 150).encode()),
    ("http://a/9", 200, "text/csv", None, b"h,i\n1,2"),
    ("http://a/10", 200, "image/png", None, b"\x89PNG"),
    ("http://a/11", 200, "text/plain", None, b"hello \xff"),
    ("http://a/12", 200, "text/plain", None, b"y" * 60_000),
    ("http://a/13", 200, "text/plain", "999999999999", b"y"),
    ("http://a/14", 200, "text/html", None, b"".join(b"<h2>S%d</h2><p>" % i + b"z" * 15_000 + b"</p>" for i in range(5))),
    ("http://a/15", 200, "application/json", None, b"[" + b" " * 60_000 + b"x]"),
]


@pytest.fixture(scope="module")
def responses(spark):
    df = spark.createDataFrame(ROWS, "url string, status int, content_type string, content_length string, body binary")
    pdf = F.when(F.col("url").endswith("pdf"), "intro\nABSTRACT\nbody")
    return df.withColumns({"fetched_at": F.lit(AT).cast("timestamp"), "pdf_text": pdf})


@pytest.fixture(scope="module")
def members(spark, responses):
    ids = responses.filter(F.col("url").endswith("zip")).select(record_id(F.col("url"), F.col("fetched_at")).alias("archive_id"))
    entries = spark.createDataFrame([(0, "d/", True), (1, "a.txt", False)], "entry_index long, entry_name string, is_directory boolean")
    extra = {"size": F.lit(5).cast("long"), "content": F.lit(" hi "), "failed": F.lit(False)}
    return ids.join(entries).withColumns(extra)


@pytest.fixture(scope="module")
def tables(responses, members, tmp_path_factory):
    return run_ingest(responses, str(tmp_path_factory.mktemp("out")), members, size_limit=SIZE_LIMIT_BYTES)


def rows(spark, tables, name):
    return spark.read.parquet(tables.path(name)).collect()


def number(url):
    return url.rsplit("/", 1)[1]


def test_results(spark, tables):
    got = {number(r.url): (r.type, r.inline, r.data) for r in rows(spark, tables, "results")}
    assert got == {
        "1": ("markdown", True, "# Hi\n\nx"),
        "3": ("json", True, '{\n  "a": [\n    1,\n    2\n  ]\n}'),
        "5": ("json", False, ""),
        "6.pdf": ("pdf", False, ""),
        "7.zip": ("zip", False, ""),
        "8": ("csv", False, ""),
        "9": ("csv", True, "| h | i |\n| --- | --- |\n| 1 | 2 |"),
        "10": ("binary", False, ""),
        "11": ("text", True, "hello �"),
        "12": ("text", False, ""),
        "14": ("markdown", False, ""),
    }


def test_records_and_chunks_belong_together(spark, tables):
    records = {r.record_id: r for r in rows(spark, tables, "records")}
    assert {r.url.replace("http://a/", ""): r.content_type for r in records.values()} == {
        "5": "application/json", "6.pdf": "application/pdf", "pdf:text:6.pdf": "text/markdown", "7.zip": "application/zip",
        "zip:contents:7.zip": "text/plain", "8": "text/csv", "10": "image/png", "12": "text/plain", "14": "text/html",
    }
    keys = {}
    for c in sorted(rows(spark, tables, "chunks"), key=lambda c: c.chunk_index):
        keys.setdefault(records[c.record_id].url.replace("http://a/", ""), []).append(c.key)
    assert keys == {
        "5": [f"k{i}" for i in range(10)],
        "pdf:text:6.pdf": ["introduction"],
        "zip:contents:7.zip": ["index", "a.txt"],
        "8": ["rows_1_100", "rows_101_150"],
        "12": ["content"],
        "14": [f"s{i}" for i in range(5)],
    }


def test_originals_and_rejects(spark, tables):
    assert {(r.key, r.filename, bytes(r.body)) for r in rows(spark, tables, "originals")} == {
        ("document", "document.pdf", b"%PDF"), ("archive", "archive.zip", b"PK"), ("file", "file.bin", b"\x89PNG"),
    }
    assert {(number(r.url), r.stage, r.reason) for r in rows(spark, tables, "rejects")} == {
        ("2", "status", "HTTP 404"),
        ("4", "convert", "invalid JSON"),
        ("13", "size", "Download too large: 999999999999 bytes exceeds 104857600 byte limit"),
        ("15", "convert", "invalid JSON"),
    }


def test_forced_inline_returns_all_data(responses):
    staged = classify(S.admitted(responses))
    got = {number(r.url): (r.inline, len(r.data)) for r in route(staged, force_inline=True).results.collect()}
    assert got["5"] == (False, len(json.dumps(json.loads(ROWS[4][4]), indent=2))) and got["8"][1] > 1_000 and got["12"] == (False, 60_000) and got["14"][1] > 75_000
    assert got["1"] == (True, len("# Hi\n\nx"))


def test_archives_without_members_have_failed(responses):
    routed = route(classify(S.admitted(responses)))
    assert not [r for r in routed.records.collect() if r.url.startswith("zip:")]


def test_size_limits_are_strict(spark):
    data = [("5", b"123"), ("6", b"123"), (None, b"12345"), (None, b"123456"), ("junk", b"1"), ("7 bytes", b"1"), ("", b"1")]
    df = spark.createDataFrame(data, "content_length string, body binary")
    got = [r[0] is None for r in df.select(S.size_reject(5)).collect()]
    assert got == [True, False, True, False, True, False, True]


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, "url string, status int, content_type string, content_length string, body binary")
    df = df.withColumn("fetched_at", F.lit(AT).cast("timestamp"))
    df.repartition(3).write.parquet(source)

    def transform(batch):
        return classify(S.admitted(batch)).drop("body")

    def run():
        write_batches(S.stream_responses(spark, source, 1), transform, out, str(tmp_path / "cp")).awaitTermination()
        return sorted(map(str, spark.read.parquet(out).drop("stream", "batch_id").collect()))

    batch = sorted(map(str, transform(S.read_responses(spark, source)).collect()))
    assert run() == batch
    # New files only: a second run adds what is new, and nothing twice.
    df.limit(1).withColumn("url", F.lit("http://b/1")).write.mode("append").parquet(source)
    assert len(run()) == len(batch) + 1
    # A new checkpoint counts its batches from 0 again; what the first stream wrote stays.
    write_batches(S.stream_responses(spark, source, 1), transform, out, str(tmp_path / "other")).awaitTermination()
    assert spark.read.parquet(out).count() == 2 * (len(batch) + 1)


def test_every_response_is_admitted_or_rejected(spark):
    data = [("a", None, b"x", None), ("b", 200, None, None), ("c", 200, b"x", "9" * 60), ("d", 200, b"x", "0" * 60 + "1"), ("e", 500, None, None), ("f", 200, b"x", "-" + "9" * 50)]
    df = spark.createDataFrame(data, "url string, status int, body binary, content_length string")
    rejects = {r.url: (r.stage, r.reason) for r in S.rejected(df, 5).collect()}
    assert {r.url for r in S.admitted(df, 5).collect()} == {"d", "f"}
    assert rejects["a"] == ("status", "missing status") and rejects["b"] == ("body", "missing body")
    assert rejects["c"][0] == "size" and "9" * 60 in rejects["c"][1] and rejects.keys() == {"a", "b", "c", "e"}
    assert {r.url for r in S.admitted(df, None).collect()} == {"c", "d", "f"}


def test_days_do_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 23:30:00 UTC' AS t")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert str(df.select(utc_day(F.col("t"))).first()[0]) == "2024-01-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_repeated_documents_stay_apart(spark):
    html = spark.createDataFrame([(1, "<h2>a</h2><p>x</p>")] * 2 + [(1, "<h2>b</h2>y")], "page_id long, html string")
    assert sorted(r.markdown for r in H.html_to_markdown(html).collect()) == ["## a\n\nx"] * 2 + ["## b\n\ny"]
    assert sorted((r.key, r.content) for r in H.html_sections(html).collect()) == [("a", "x")] * 2 + [("b", "y")]
    texts = spark.createDataFrame([(1, '{"a": 1}')] * 2 + [(1, "[2")], "doc_id long, json string")
    assert sorted((r.valid, r.pretty or "") for r in J.json_pretty(texts).collect()) == [(False, "")] + [(True, '{\n  "a": 1\n}')] * 2
    assert [(r.key, r.content) for r in J.split_json(texts).collect()] == [("a", "1")] * 2
