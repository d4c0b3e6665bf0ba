"""The physical plans: where data is shuffled, and that nothing leaves the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from docpipe.operators import csv_cells as C
from docpipe.operators import html as H
from docpipe.operators import json_tokens as J
from docpipe.operators import store as R
from docpipe.operators import text as X
from docpipe.queries import fixtures as D
from docpipe.queries.registry import QUERIES

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


@pytest.mark.parametrize("job", [X.split_text, X.text_sections, X.text_lines, X.text_headings, X.text_paragraphs, X.text_fallback])
def test_text_needs_no_shuffle(spark, plan, job):
    assert exchanges(plan(job(read(spark, "documents")))) == []


@pytest.mark.parametrize("job", [C.csv_cells, C.csv_shape, C.csv_to_markdown, C.split_csv])
def test_csv_needs_no_shuffle(spark, plan, job):
    df = read(spark, "documents").select("doc_id", F.col("text").alias("csv"))
    assert exchanges(plan(job(df))) == []


@pytest.mark.parametrize("job", [H.html_to_markdown, H.html_blocks, H.html_sections, H.html_section_markdown, H.html_links])
def test_html_shuffles_documents_once(spark, plan, job):
    text = plan(job(read(spark, "pages")))
    assert exchanges(text) == ["hashpartitioning"]
    # What is shuffled is the document, before it is cut into tokens.
    assert text.index("Generate posexplode") < text.index("Exchange")


@pytest.mark.parametrize("job", [J.json_valid, J.json_pretty, J.split_json])
def test_json_shuffles_documents_once(spark, plan, job):
    df = read(spark, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json"))
    assert exchanges(plan(job(df))) == ["hashpartitioning"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_ingest", "route_summary"}))
def test_no_python_in_any_query(spark, plan, name):
    assert not re.search(r"Python|ArrowEval|MapInPandas", plan(QUERIES[name](spark, SF)))


def test_age_tests_reach_the_scan(spark, plan, tmp_path):
    path = str(tmp_path / "records")
    D.fetch_records(spark, SF).write.parquet(path)
    text = plan(R.list_records(spark.read.parquet(path), D.AS_OF))
    assert "PushedFilters: [Or(GreaterThanOrEqual(fetched_at," in text


def test_summary_reads_content_of_first_chunks_only(spark, plan, tmp_path):
    path = str(tmp_path / "chunks")
    D.record_chunks(spark, SF).write.parquet(path)
    text = plan(R.record_summary(spark.read.parquet(path)))
    scans = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", text)
    assert {("content" in schema, "EqualTo(chunk_index,0)" in filters) for filters, schema in scans} == {(True, True), (False, False)}
