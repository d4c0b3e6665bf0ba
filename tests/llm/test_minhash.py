import random

import numpy as np
import pytest

from docpipe.llm import minhash
from docpipe.llm.minhash import components, describe, near_duplicates, shingle_sets, signatures


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(documents, size):
    rng = random.Random(size)
    texts = []
    for _ in range(15):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 150))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 20)):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
    expected = brute(list(enumerate(texts)), size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(texts), size).collect()}
    assert got == expected


def test_chains_reach_across(documents):
    """A chain of texts, each like the next only: one component."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[k * 8 :] + [f"z{i}" for i in range(k * 8)]) for k in range(12)]
    expected = brute(list(enumerate(texts)), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(texts), 2).collect()} == expected
    assert len({c for _, c in expected.values()}) < 12


def test_repeated_rows_in_the_last_round(documents, monkeypatch):
    """Rows that repeat whole add nothing to the shingles of their class, which the last round puts in order."""
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 0)
    rng = random.Random(3)
    texts = []
    for k in range(40):
        words = [f"t{k}w{i}" for i in range(121)]
        texts.append(" ".join(words))
        for at in rng.sample(range(5, 115, 10), 6):
            words[at] = f"n{k}x{at}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(3)]
    expected = brute(list(enumerate(texts)), 2)
    got = near_duplicates(documents([t for _, t in rows], [i for i, _ in rows]), 2).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len({c for _, c in expected.values()}) == 40


def test_odd_rows(odd, none):
    rows = near_duplicates(odd, 2).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (0, i, True) for i in (0, 1, 2))
    assert by_id[5].component_id == 4 and by_id[7].component_id == 6 and not by_id[7].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_duplicates(none).count() == 0


def test_a_null_id_beside_a_number(documents):
    rows = near_duplicates(documents(["a b c d", "a b c d", "a b c d"], [None, 9, 7]), 2).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in rows} == {None: (7, False), 9: (7, False), 7: (7, True)}


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in label if find(x) != x}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate((common, x))) for x in (a, b)]
    found = signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    assert abs((found[0] == found[1]).mean() - 0.6) < 0.15


def test_sets_do_not_depend_on_blocks():
    texts = [b"a b c", b"", b"one", b"d e", b"a b c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    gram, at = shingle_sets(data, bounds, 2)
    assert np.diff(at).tolist() == [2, 0, 1, 1, 2] and gram[at[0] : at[1]].tolist() == gram[at[4] : at[5]].tolist()


def test_no_python_rows_for_copies(documents):
    found = describe(documents(["a b c"] * 50), 2)
    assert found.select("digest").distinct().count() == 1
