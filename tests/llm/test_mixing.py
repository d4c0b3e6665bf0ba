"""Targets against a plain loop, rounding against a plain walk over the same draws, odd tables."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from docpipe.llm import mixing
from docpipe.llm.mixing import draw_of, lot_of, mix_sources, op11_mixing, targets
from tests.llm.conftest import ODD

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def plain_targets(sizes):
    """Shares by weight; what stops at twice its size gives its excess to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    wanted, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        per = wanted / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * per >= 2 * sizes[s]}
        if not above:
            return out | {s: float(weight[s] * per) for s in open_}
        out |= {s: 2.0 * sizes[s] for s in above}
        wanted -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1, "b": 1000, "c": 10, None: 5},
        {"é": 7, "z": 900, "Z": 3, "": 40, "😀": 60, "�": 1},
        {f"s{i}": 3**i for i in range(12)},
    ],
)
def test_targets(spark, sizes):
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = plain_targets(sizes)
    assert len(got) == len(sizes)
    for row in got:
        assert row["target"] == pytest.approx(expected[row["source"]], rel=1e-12)


def plain_lot(items):
    """(taken by id, rest id, its mass): each document meets all smaller ones of its lot. items: id, size, mass, draw."""
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    mass = {i: m for i, _, m, _ in items}
    size = {i: s for i, s, _, _ in items}
    taken = {}
    for at, (i, _, _, draw) in enumerate(items):
        others = [j for j, *_ in items[at + 1 :]]
        has, lacks = sum(mass[j] for j in others), sum(size[j] - mass[j] for j in others)
        free = size[i] - mass[i]
        if draw * (min(free, has) + min(mass[i], lacks)) < min(mass[i], lacks):
            if free >= has:
                return taken | dict.fromkeys(others, False), i, mass[i] + has
            taken[i] = True
            for j in others:
                mass[j] *= 1 - free / has
        else:
            if mass[i] >= lacks:
                return taken | dict.fromkeys(others, True), i, mass[i] - lacks
            taken[i] = False
            for j in others:
                mass[j] = size[j] - (size[j] - mass[j]) * (1 - mass[i] / lacks)
    raise AssertionError


def test_tree(spark, documents):
    """Two levels of lots, against the plain walk with the draws of the operator."""
    texts = ["w " * (1 + (i * i) % 97) for i in range(90)]
    sources = ["abc"[i % 3] for i in range(90)]
    docs = documents(texts, sources=sources)
    got = {r["doc_id"]: r for r in mix_sources(docs, lot=8).collect()}
    items = spark.createDataFrame([(s, i, len(t.split())) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "source string, doc_id long, size long")
    for source in "abc":
        rows = [r for r in got.values() if r["source"] == source]
        target, size = rows[0]["target"], rows[0]["source_size"]
        assert size == sum(r["size"] for r in rows)
        wanted = target / size
        left = {r["doc_id"]: (wanted - floor(wanted)) * r["size"] for r in rows} if wanted < 2 else {}
        taken, lots, level = {}, -(-len(rows) // 8), 0
        while left:
            drawn = items.filter(F.col("source") == source).withColumn("lots", F.lit(lots)).select("doc_id", "size", lot_of(0, level), draw_of(0, level)).collect()
            by_lot = defaultdict(list)
            for i, s, lot, draw in drawn:
                if i in left:
                    by_lot[lot].append((i, s, left[i], draw))
            rests = {}
            for lot in by_lot.values():
                decided, rest, mass = plain_lot(lot)
                taken |= decided
                rests[rest] = mass
            if lots == 1:
                ((rest, mass),) = rests.items()
                taken[rest] = 2 * mass >= got[rest]["size"]
                break
            left, lots, level = rests, -(-lots // 8), level + 1
        for r in rows:
            assert r["taken"] == r["size"] * (floor(wanted) + taken.get(r["doc_id"], False))
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)


def test_unbiased(documents):
    """Over many sources with the same documents, each document is taken as often as wanted."""
    sizes, n = (40, 3, 17, 60, 8, 25, 31, 5), 150
    docs = documents(["w " * s for s in sizes] * n, sources=[f"s{i // len(sizes)}" for i in range(n * len(sizes))])
    rows = mix_sources(docs, weights=(1,), share=(1, 3)).collect()
    for place in range(len(sizes)):
        taken = [r["taken"] / r["size"] for r in rows if r["doc_id"] % len(sizes) == place]
        assert len(taken) == n and abs(sum(taken) / n - 1 / 3) < 0.15


def test_repeated_rows(documents, monkeypatch):
    """Rows that are alike share their copies; many of them are dealt in blocks."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    docs = documents(["a b c"] * 300 + ["a b c d"] * 5, ids=[7] * 200 + [None] * 100 + [1, 2, 3, 4, 5], sources=["x"] * 300 + ["y"] * 5)
    got = mix_sources(docs, share=(1, 2)).collect()
    assert len(got) == 305
    for source in "xy":
        rows = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 4
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)


def test_blocks_of_copies(spark):
    decided = spark.createDataFrame([("s", 1, 4, 100), ("s", 2, 4, 3)], "source string, doc_id long, size long, copies long")
    got = mixing._each(decided, block=16).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 100, 2: 3}
    assert sorted(r["_copy"] for r in got if r["doc_id"] == 1) == list(range(100))


def test_odd(odd, none):
    got = mix_sources(odd).collect()
    again = mix_sources(odd.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == odd.count()
    sizes = Counter(len(WORD.findall(t or "")) for t in [*ODD, "one two", ODD[6], "nobody's text"])
    assert Counter(r["size"] for r in got) == sizes
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix_sources(none).collect() == []
    assert mix_sources(none).columns == ["source", "doc_id", "size", "source_size", "target", "taken"]


def test_no_words(documents):
    got = mix_sources(documents([None, "", " \n"], sources=["a", None, "a"])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 3


def test_query(spark):
    rows = op11_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"] or ""))
    expected = plain_targets(sizes)
    source = {d["doc_id"]: d["source"] for d in docs}
    taken = Counter()
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s], rel=1e-12)
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, want in expected.items():
        assert abs(taken[s] - want) <= max(r["size"] for r in rows if source[r["doc_id"]] == s)
