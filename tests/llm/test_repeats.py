import random

import numpy as np
import pyarrow as pa

from docpipe.llm.repeats import WINDOW, _extend, minimisers, repeated_passages
from docpipe.llm.words import words


def brute(rows, length=50):
    split = [(i, (t or "").encode().split(), t) for i, t in rows]
    owner = {}
    for i, w, t in split:
        for k in range(len(w) - length + 1):
            owner.setdefault(tuple(w[k : k + length]), set()).add(t)
    copies = {}
    for _, _, t in split:
        copies[t] = copies.get(t, 0) + 1
    out = set()
    for i, w, t in split:
        inside = [copies[t] > 1 and len(w) >= length] * len(w)
        for k in range(len(w) - length + 1):
            if len(owner[tuple(w[k : k + length])]) > 1:
                inside[k : k + length] = [True] * length
        k = 0
        while k < len(w):
            if inside[k]:
                start = k
                while k < len(w) and inside[k]:
                    k += 1
                out.add((i, start, k, len(w)))
            k += 1
    return out


def run(df):
    return {(r.doc_id, r.start, r.end, r.n_words) for r in repeated_passages(df).collect()}


def test_against_brute_force(documents):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 120, 400)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, 60))]
            parts += rng.choice(passages)
        texts.append(" ".join(parts))
    texts += texts[:3]
    df = documents(texts)
    assert run(df) == brute(list(enumerate(texts)))


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = run(odd)
    # Within-text repeats alone are not reported; the passage, the long copies and their repeated row are.
    assert {r[0] for r in got} == {6, 7, 10, 11} and got == brute(rows)
    assert repeated_passages(none).count() == 0


def test_every_window_has_a_minimiser():
    data = np.frombuffer(" ".join(f"w{i * 7919 % 1000}" for i in range(2000)).encode(), np.uint8)
    at = minimisers(words(data, np.array([0, len(data)])))
    assert (np.diff(at) <= WINDOW).all() and at[0] < WINDOW and len(at) < 2000 / 8


def test_lines_of_a_small_pool(documents):
    """Texts put together from few lines: windows around one minimiser that very many texts have in other surroundings."""
    rng = random.Random(11)
    lines = [" ".join(f"l{k}x{i}" for i in range(rng.randint(10, 30))) for k in range(12)]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(4, 12))) for _ in range(120)]
    assert run(documents(texts)) == brute(list(enumerate(texts)))


def test_a_match_between_better_neighbours(documents):
    """A and C share 56 words, but in either order A stands next to texts that share more with it on one side."""
    word = iter(f"q{i}" for i in range(10**6))
    fresh = lambda n: [next(word) for _ in range(n)]
    middle = fresh(140)
    # Every cut around every word, so that some of them lies at a minimiser as described.
    texts = [" ".join(middle)]
    for i in range(45, 90):
        for left, right in ((20, 36), (4, 45), (21, 28)):
            for _ in range(2 if left != 20 else 1):
                texts.append(" ".join(fresh(30) + middle[i - left : i + right] + fresh(30)))
    rows = list(enumerate(texts))
    alone = [texts[0], texts[1]]
    assert run(documents(texts)) == brute(rows) and run(documents(alone)) == brute(list(enumerate(alone)))


def sorted_suffixes(rng, n, width):
    """Suffixes of few letters in order, in the columns that _extend reads."""
    keys = sorted((rng.randint(0, 2), tuple(rng.randint(1, 2) for _ in range(4)), tuple(rng.randint(0, 1) for _ in range(width - 1))) for _ in range(n))
    keys = sorted(set(keys))
    low = [rng.randint(0, 3) for _ in keys]
    high = [x + (rng.random() < 0.1) for x in low]
    pack = lambda part: [np.array(k[part], ">u8").tobytes() for k in keys]
    n = len(keys)
    return pa.record_batch(
        {"key": [k[0] for k in keys], "node": [str(i).encode() for i in range(n)], "right": pack(1), "left": pack(2), "low": low, "high": high}
        | {"most_right": pa.array([0] * n, pa.int32()), "most_left": pa.array([0] * n, pa.int32())}
        | {"first": pa.array([3] * n, pa.int32()), "last": pa.array([-1] * n, pa.int32())}
    )


def test_neighbours_do_not_depend_on_batches():
    rows = sorted_suffixes(random.Random(3), 200, 3)
    answers = []
    for size in (1, 2, 7, 1000):
        batches = [rows.slice(i, size) for i in range(0, rows.num_rows, size)]
        answers.append(pa.Table.from_batches(list(_extend(4, 3, "right")(iter(batches)))).to_pylist())
    assert len(answers[0]) == rows.num_rows and all(a == answers[0] for a in answers)
    given = rows.to_pylist()
    common = lambda a, b: next((i for i in range(len(a) // 8) if a[8 * i : 8 * i + 8] != b[8 * i : 8 * i + 8] or not any(a[8 * i : 8 * i + 8])), len(a) // 8)
    ends = {0, rows.num_rows - 1}
    for i, (row, got) in enumerate(zip(given, answers[0], strict=True)):
        others = [o for o in given if o["key"] == row["key"] and not (o["low"] == o["high"] == row["low"] == row["high"])]
        most = max((common(row["right"], o["right"]) for o in others), default=0)
        assert got["most_right"] == most or (got["most_right"] == 4 and (i in ends or given[0]["low"] == row["low"] or given[-1]["low"] == row["low"]))


def test_ranges_over_many_tasks(spark, documents):
    """A passage that all texts have, sorted over many tasks whose ends do not see their neighbours."""
    rng = random.Random(5)
    passage = [f"h{i}" for i in range(90)]
    texts = [" ".join([f"a{k}x{i}" for i in range(rng.randint(0, 40))] + passage[: rng.randint(45, 90)] + [f"b{k}x{i}" for i in range(rng.randint(0, 30))]) for k in range(80)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(documents(texts)) == brute(list(enumerate(texts)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
