import random

import numpy as np
import pytest

from docpipe.llm import quality_model
from docpipe.llm.quality_rules import fit_prior, host_verdicts, quality_rules, statistics


def rules(text):
    words = (text or "").encode().split()
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(documents, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "ab\n", "é#", " ", "\n", "\t", "| ", "x y z a b c d e f "]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    for df in (documents(texts), odd):
        wanted = sorted(str((r.doc_id, *rules(r.text))) for r in df.collect())
        got = statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert sorted(str(tuple(r)) for r in got) == wanted


def test_hosts(documents, none):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    texts = [bad] * 95 + [good] * 5 + [good] * 95 + [bad] * 5 + [bad]
    sources = ["bad"] * 100 + ["good"] * 100 + [None]
    judged = quality_rules(documents(texts, sources=sources))
    kept = {(r.host, r.base_failed): r.kept for r in judged.collect()}
    assert kept[("bad", False)] is False and kept[("good", False)] is True and kept[("good", True)] is False
    rates = {r.host: r for r in host_verdicts(statistics(documents(texts, sources=sources))).collect()}
    assert 0.05 < rates["good"].rate_base < 0.2 and rates[None].rate_base < 1  # a single failure says little
    assert quality_rules(none).count() == 0


def test_each_rule_rejects_its_host(documents):
    """A host whose documents repeat their lines, or hold hardly anything but symbols, goes by that rule alone."""
    words = [" ".join(f"w{i * 7 + k}" for k in range(30)) for i in range(60)]
    lines = "\n".join(["the very same line of seven words", "and a second one of eight words here"] * 3)
    symbols = " ".join(f"#$%{k}" for k in range(30))
    mixed = [*words[:12], *[lines] * 8]  # mostly clean
    texts = [*words, *[f"{lines}\nits own line {i} with a few more words to be long enough for the rule" for i in range(40)], *[f"{symbols} {i}" for i in range(40)], *mixed]
    sources = ["clean"] * 60 + ["lines"] * 40 + ["symbols"] * 40 + ["mixed"] * len(mixed)
    counted = statistics(documents(texts, sources=sources)).cache()
    rates = {r.host: r for r in host_verdicts(counted).collect()}
    assert {h for h, r in rates.items() if not r.host_ok} == {"lines", "symbols"}
    assert rates["lines"].rate_lines > 0.9 > rates["lines"].rate_symbols
    assert rates["symbols"].rate_symbols > 0.9 > rates["symbols"].rate_lines
    kept = {(r.host, r.base_failed, r.kept) for r in quality_rules(documents(texts, sources=sources)).collect()}
    assert ("lines", False, True) not in kept and ("symbols", False, False) in kept and ("clean", False, True) in kept


def test_repeated_rows_in_fit(spark, documents, monkeypatch):
    """What reaches the driver is bounded by the sample, not by the rows that carry a labelled id."""
    docs = documents(["good words here", "bad"] * 500 + ["other text"] * 20, ids=[1, 2] * 500 + [1] * 20)
    labels = spark.createDataFrame([(1, 1), (2, 0)] * 30, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_model, "grow", lambda x, y: seen.append((len(x), len(y))))
    quality_model.fit(docs, labels, sample=2)
    usable = [i for i in (1, 2) if not __import__("zlib").crc32(str(i).encode()) % quality_model.FOLDS == 0]
    assert seen == [(len(usable), len(usable))]


def test_prior_of_alike_hosts_is_strong(spark):
    alike = spark.createDataFrame([(f"h{i}", 100, 10) for i in range(5)], "host string, n long, base long")
    apart = spark.createDataFrame([(f"h{i}", 100, 100 * (i % 2)) for i in range(6)], "host string, n long, base long")
    assert fit_prior(alike, "base").alpha == pytest.approx(10, rel=0.01) and fit_prior(apart, "base").alpha < 1


def test_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(quality_model.FEATURES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    trees = quality_model.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    nothing = quality_model.grow(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))
    assert (nothing.score(x) == 0.5).all()
    assert quality_model.grow(x[:50], np.ones(50)).score(x).min() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    df = quality_model.op3_quality_model(spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = df.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1)], "doc_id long, quality int")
    trees = quality_model.fit(odd, labels)
    scores = quality_model.score_documents(odd, trees).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality_model.score_documents(none, quality_model.fit(none, labels.limit(0))).count() == 0
