import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docpipe.functions import text as T
from docpipe.operators import text as X


def chunks_of(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append((r.key, r.title, r.content))
    return out


def test_trim_and_blank(apply):
    values = ["  a ﻿", "\t\n", "b", "　x y "]
    assert apply(values, T.trim(F.col("v"))) == ["a", "", "b", "x y"]
    assert apply(values, T.trim_long(F.col("v"))) == ["a", "", "b", "x y"]
    assert apply(values, T.is_blank(F.col("v"))) == [False, True, False, False]


def test_decode_utf8(apply):
    values = [b"\x61\xff\x62", b"\xe2\x82", b"\xef\xbb\xbfx", "é😀".encode()]
    assert apply(values, T.decode_utf8(F.col("v")), "binary") == ["a�b", "�", "﻿x", "é😀"]


def test_large_counts_bytes_and_is_strict(apply):
    values = ["x" * 51_200, "x" * 51_201, "é" * 25_600, "é" * 25_601]
    assert apply(values, T.is_large(F.col("v"))) == [False, True, False, True]


def test_slug(apply):
    values = ["Hello, World!", "日本語", "__a__", "a" * 59 + " b c", "É t"]
    assert apply(values, T.slug(F.col("v"))) == ["hello_world", "section", "a", "a" * 59 + "_", "t"]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("1. Intro", True), ("1.2.3 Deep", True), ("1.", False), ("1.2.", True), ("2024", True), ("----", True), ("Chapter 1", True),
        ("section  12 x", True), ("Section x", False), ("ABC", False), ("ABCD", True), ("Introductions follow", True), ("Introductory words", False),
        ("methodical", True), ("plain line", False), ("A" * 120, True), ("A" * 121, False), ("x", False), ("straße", False),
        ("STRAßE", False), ("1 Title x", True), ("a line:", False),
    ],
)
def test_heading(spark, line, expected):
    assert spark.range(1).select(T.is_heading(T.trim(F.lit(line))).alias("h")).first().h is expected


def test_sections(table):
    text = "intro\n\n  kept indent\n1. First\nbody \n\nCHAPTER TWO\nABSTRACT\nend"
    got = chunks_of(X.text_sections(table([text])))[0]
    assert got == [
        ("introduction", "introduction", "intro\n  kept indent"),
        ("1_first", "1. First", "body"),
        ("abstract", "ABSTRACT", "end"),
    ]


def test_paragraphs_only_without_sections(table):
    df = table(["AAAA\n\n\nBBBB\n\n \n\nCCCC", "text\n\nmore", "", "  \n"])
    got = chunks_of(X.text_paragraphs(df))
    assert got == {0: [("para_0", "paragraph 1", "AAAA"), ("para_1", "paragraph 2", "BBBB"), ("para_2", "paragraph 3", "CCCC")]}
    assert chunks_of(X.split_text(df))[1] == [("introduction", "introduction", "text\nmore")]


def fold(lengths, limit=1000):
    groups = []
    for n in lengths:
        if groups and (groups[-1][0] < limit or n < limit):
            groups[-1] = (groups[-1][0] + 2 + n, groups[-1][1] + [n])
        else:
            groups.append((n, [n]))
    return [g[1] for g in groups]


def merged(spark, cases, limit=1000):
    rows = [(i, [(f"k{j}", f"t{j}", "x" * n) for j, n in enumerate(ns)]) for i, ns in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, s array<struct<key:string,title:string,content:string>>")
    out = df.select("i", T.merge_small(F.col("s"), limit).alias("m")).collect()
    return {r.i: [(c.key, [len(p) for p in c.content.split("\n\n")]) for c in r.m] for r in out}


def expected_merge(ns, limit=1000):
    at, out = 0, []
    for group in fold(ns, limit):
        out.append((f"k{at}", group))
        at += len(group)
    return out


def test_merge_at_the_limits(spark):
    sizes = [999, 1000, 1001]
    cases = [[a, b, c] for a in sizes for b in sizes for c in sizes] + [[], [5], [500, 498, 1000], [500, 497, 1000]]
    got = merged(spark, cases)
    assert got == {i: expected_merge(ns) for i, ns in enumerate(cases)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_merge_equals_fold(spark, seed):
    rng = random.Random(seed)
    cases = [[rng.randint(1, 14) for _ in range(rng.randint(0, 12))] for _ in range(2_000)]
    assert merged(spark, cases, 9) == {i: expected_merge(ns, 9) for i, ns in enumerate(cases)}


def test_fallback_and_outcomes(table):
    rows = {r.doc_id: r for r in X.text_fallback(table(["ab", "abc"]), limit=2).collect()}
    assert (rows[0].inline, rows[0].data, rows[0].key) == (True, "ab", None)
    assert (rows[1].inline, rows[1].data, rows[1].key, rows[1].content) == (False, "", "content", "abc")
    got = [r.content for r in X.pdf_text_outcomes(table([None, " \n", "x"])).orderBy("doc_id").collect()]
    assert got == ["PDF text extraction failed", "PDF contains no extractable text", None]


def test_section_files(table):
    df = X.section_files(X.split_text(table(["AAAA\n\nBBBB"])))
    assert [r.filename for r in df.orderBy("chunk_index").collect()] == ["section_00.md", "section_01.md"]
