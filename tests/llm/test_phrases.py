"""Collocations against a plain count of all runs of words; blocks, collisions, odd tables."""

import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docpipe.llm import phrases
from docpipe.llm.phrases import Block, Ranges, _cut, _distinct, _frequent, _long_runs, _read, _sum_range, collocations, text_blocks
from tests.llm.conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000):
    """rows: (lang, text)."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in collocations(docs, **options).collect())


def with_langs(docs, langs):
    from pyspark.sql import functions as F

    table = F.array(*[F.lit(x) for x in langs])
    return docs.withColumn("lang", F.get(table, (F.col("doc_id") % len(langs)).cast("int")))


@pytest.fixture
def prose(documents):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "The", "of", "new", "york", "city", "hall", "é", "😀", "a-b", "x" * 40, "\x1c"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    texts = ["".join(vocabulary[min(int(rng.exponential(3)), 11)] + marks[rng.integers(len(marks))] for _ in range(rng.integers(0, 120))) for _ in range(120)]
    return documents([*texts, None, "", *texts[:3]]), [*texts, None, "", *texts[:3]]


def test_brute_force(prose):
    docs, texts = prose
    langs = ["en", "de", "en", None, "a language with a long name", "a language with a long nam3"]
    expected = plain([(langs[i % 6], t) for i, t in enumerate(texts)], least=6)
    assert len({lang for lang, *_ in expected}) == 5
    assert got(with_langs(docs, langs), least=6) == expected


def test_top(prose, top=7):
    docs, texts = prose
    assert got(docs, least=6, top=top) == plain([("en", t) for t in texts], least=6, top=top)


def test_small_blocks(prose, monkeypatch):
    """Blocks that end after any piece change nothing, nor does a text that is longer than a block."""
    docs, texts = prose
    cut = phrases._cut
    monkeypatch.setattr(phrases, "BLOCK", 50)
    parts = list(cut(iter([__import__("pyarrow").record_batch({"lang": ["en"] * 3, "text": [texts[0], "", texts[1] * 5]})])))
    data = b"".join(p.column("data")[0].as_py() for p in parts)
    assert len(parts) > 5
    assert [w for p in data.split(b"\n") for w in p.split()] == [w.encode() for t in (texts[0], texts[1] * 5) for w in re.findall("[^ \t\n.,;]+", t.translate(LOWER))]


def test_collisions(monkeypatch):
    """Runs with one fingerprint are counted apart."""
    monkeypatch.setattr(Block, "fingerprints", lambda self, at, k: np.zeros(len(at), np.int64))
    block = Block("en", b"a b a b c a b\n")
    found = [(int(n), int(w)) for counts, first in _distinct(block, block.runs(2), 2, block.same_words()) for n, w in zip(counts, first, strict=True)]
    assert sorted(found) == [(1, 1), (1, 3), (1, 4), (3, 0)]


def test_equal_hashes_of_words():
    block = Block("en", b"a b a cc\n")
    block.hashes = np.zeros(4, np.uint64)
    assert block.same_words().tolist() == [0, 1, 0, 2]


def test_odd(odd, none):
    rows = [("en", t) for t in [*ODD, "one two", ODD[6], "nobody's text"]]
    assert got(odd) == plain(rows)
    assert got(none) == []
    assert text_blocks(none).count() == 0
    assert collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def random_words(n, kinds, seed=3):
    found = [f"w{i}" for i in np.random.default_rng(seed).integers(0, kinds, n)]
    return " ".join(w + "." * (i % 12 == 11) for i, w in enumerate(found))


def test_told_by_bits():
    """A block is told of its frequent fingerprints by one bit for each that it sent, whatever ranges these fall into."""
    ranges, least = Ranges(4), 3
    datas = [random_words(400, 150, seed).replace(".", "\n").encode() + b"\n" for seed in range(5)]
    blocks = [Block("en", data) for data in datas]
    sent = pa.concat_tables(pa.table(ranges.packed(b.fingerprints(b.runs(2), 2), 2, i, least)) for i, b in enumerate(blocks))
    got = [_sum_range(least)(sent.filter(pa.compute.equal(sent["range"], r))) for r in range(16)]
    told = pa.concat_tables(got)
    assert told.column_names == ["k", "range", "block", "bits"]
    of = {(r["range"], r["block"]): len(r["cells"]) // phrases.CELL for r in sent.to_pylist()}
    assert all(len(r["bits"]) == -(-of[r["range"], r["block"]] // 8) for r in told.to_pylist())
    counts = Counter(int(x) for b in blocks for x in ranges.short(b.fingerprints(b.runs(2), 2)))
    assert 0 < sum(n >= least for n in counts.values()) < len(counts)
    for i, b in enumerate(blocks):
        at = b.runs(2)
        expected = sorted({int(x) for x in ranges.short(b.fingerprints(at, 2)) if counts[int(x)] >= least})
        own = told.filter(pa.compute.equal(told["block"], i)).select(["k", "range", "bits"])
        assert _frequent(b, at, 2, ranges, own).tolist() == expected
        assert _frequent(b, at, 1, ranges, own).tolist() == []
    with pytest.raises(ValueError, match="other fingerprints"):
        _frequent(blocks[0], blocks[0].runs(2)[:9], 2, ranges, told.select(["k", "range", "bits"]))


def test_block_by_block(prose, monkeypatch):
    """A block and what it is told are a group of narrow rows: nothing is gathered in a cell, and no batch holds several blocks."""
    plans, plain_written = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, name, *a: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or plain_written(df, name, *a))
    assert got(prose[0], least=6) == plain([("en", t) for t in prose[1]], least=6)
    assert [name for name, _ in plans] == ["blocks", "frequent", "longer", "phrases"]
    for name, plan in plans:
        assert "collect_list" not in plan and "Join" not in plan
        assert ("MapInArrow" in plan) == (name in ("blocks", "frequent"))
        assert plan.count("FlatMapGroupsInArrow") == {"blocks": 0, "longer": 2}.get(name, 1)


def test_whole_group(monkeypatch):
    """The rows of a block may come in any order and in several batches; phrases leave in small batches."""
    monkeypatch.setattr(phrases, "PHRASES", 7)
    ranges, data = Ranges(4), (b"a b c d e\n" * 30) + b"x y\n"
    block = Block("en", data)
    told = []
    for k in (1, 2, 3, 4):
        at = block.runs(k)[: {3: 90, 4: 60}.get(k)]  # all in which the pairs are frequent
        told.append(_sum_range(30)(pa.table(ranges.packed(block.fingerprints(at, k), k, 0, 30))))
    own = pa.concat_tables(told).select(["k", "range", "bits"])
    schema = pa.schema({"lang": pa.string(), "data": pa.binary(), **{f.name: f.type for f in own.schema}})
    nulls = lambda n, kind: pa.nulls(n, kind)
    of_block = pa.table([["en"], pa.array([data], pa.binary()), nulls(1, pa.int32()), nulls(1, pa.int32()), nulls(1, pa.binary())], schema=schema)
    of_told = pa.table([nulls(len(own), pa.string()), nulls(len(own), pa.binary()), *own.columns], schema=schema)
    rows = pa.concat_tables([of_told.slice(0, 3), of_block, of_told.slice(3)])
    out = list(_read(ranges, 4)(iter(rows.to_batches(2))))
    assert all(b.num_rows <= 7 for b in out)
    words = "abcde"
    expected = {(k, " ".join(words[i : i + k])): 30 for k in range(1, 5) for i in range(6 - k)}
    assert {(r["k"], r["phrase"]): r["n"] for b in out for r in b.to_pylist()} == expected
    assert list(_read(ranges, 4)(iter(of_block.to_batches()))) == []
    assert list(_long_runs(ranges, 4, 30)((pa.scalar(0),), iter(of_block.to_batches()))) == []


def test_memory():
    """What a worker holds beside a block is a few times the block; beside a batch of texts, less than twice the batch."""
    text = random_words(330_000, 50_000)
    data = text.replace(".", "\n").encode() + b"\n"
    batch = pa.record_batch({"lang": ["en"] * 3000, "text": [text[:8000]] * 3000})
    Block("en", data[:100_000])
    tracemalloc.start()
    try:
        Block("en", data)
        assert tracemalloc.get_traced_memory()[1] < 16 * len(data)
        tracemalloc.reset_peak()
        assert sum(1 for _ in _cut(iter([batch]))) > 5
        assert tracemalloc.get_traced_memory()[1] < 2 * batch.nbytes
    finally:
        tracemalloc.stop()


def test_words_in_parts(monkeypatch):
    """Words are the same however many pieces are taken at a time."""
    data = random_words(3000, 900).replace(".", "\n").encode() + b"\n\n  \n" + "é😀 ".encode() * 50 + b"\nend"
    whole, slices = Block("en", data), phrases._slices
    monkeypatch.setattr(phrases, "_slices", lambda sizes, limit=0: slices(sizes, 64))
    parts = Block("en", data)
    for name in ("starts", "ends", "hashes", "last", "prefix"):
        assert (getattr(whole, name) == getattr(parts, name)).all()
    assert [data[s:e] for s, e in zip(parts.starts, parts.ends, strict=True)] == data.split()
