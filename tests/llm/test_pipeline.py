"""Every stage against a brute-force version on documents with copies, near copies, junk and personal data."""

import random
from collections import defaultdict

import corpus_pipeline
from docpipe.llm.common import written

from .test_minhash import brute
from .test_quality import rules


def corpus():
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 10**5)}" for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        texts.append("  ".join(words))  # an exact copy but for white space
        near = list(words)
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += ["too short", None, "", "again and again it goes round " * 40]
    texts += [f"{' '.join(f'q{i}{k}' for i in range(40))} mail a.b{k}@c.de or +49 30 123456{k}" for k in range(5)]
    return [*texts, texts[0]]  # a repeated row


def test_stages(spark, documents):
    texts = corpus()
    ids = [*range(len(texts) - 1), 0]
    df = documents(texts, ids)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = df
        df = written(stage(spark, df, ""), name)
        kept[name] = df
        if name != "packing":
            assert df.columns == before.columns

    def rows(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    source = list(zip(ids, texts, strict=True))
    good = [(i, t) for i, t in source if (w := rules(t))[0] >= 20 and 100 * w[4] <= 30 * w[0]]
    assert rows(kept["quality_rules"]) == sorted(good, key=str)

    first = {}
    for i, t in sorted(good):
        first.setdefault(" ".join(t.split()), (i, t))
    assert rows(kept["exact_dedup"]) == sorted(first.values(), key=str)

    alone = [(i, t) for i, t in first.values() if brute(list(first.values()), 5)[i][1] == i]
    assert rows(kept["minhash"]) == sorted(alone, key=str)

    masked = {i: t for i, t in rows(kept["pii"])}
    assert masked.keys() == {i for i, _ in alone}
    for i, t in alone:
        assert masked[i] == (t if "mail" not in t else t.split(" mail ")[0] + " mail [EMAIL] or [PHONE]")
    assert all(r.n_chars == len(r.text) for r in kept["pii"].collect())

    by = defaultdict(list)
    for r in df.collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in df.collect()} == masked.keys()
    for own in by.values():
        assert sum(n for _, n in own) <= 2048 and [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]


def test_stages_keep_odd_rows(spark, odd, none):
    for start in (odd, none):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = written(stage(spark, df, ""), name)
        assert set(df.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
        assert (df.count() > 0) == (start is odd)


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "minhash", "pii", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
