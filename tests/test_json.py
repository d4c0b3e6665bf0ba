import json
import random
import re
from itertools import accumulate

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docpipe.functions.arrays import running_sums
from docpipe.operators import json_tokens as J


def strict(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
    except ValueError:
        return False
    return True


LITERALS = [
    "", " ", "[]", "{}", '"s"', '{"a":1} x', "5 6", '{"a":1,"a":2}', "[1 2]", "﻿{}", "nul", "01", "[1,]", '{"a"}',
    '{"a":}', '"a":1', "[[]", " []\n", '"\x01"', '"\\x"', "[1]]", '{"a":"b":"c"}', "[,1]", "[1}", '{"a":1]', "'a'",
    "{'a':1}", '"open', "[1,,2]", "-", "1.", "-0.5e+3", '"\\u00e9"', '"\\u00g9"', '{"{": "[,:"}', '[":", ","]', "{1:2}", "]",
]


def test_validity(table):
    got = [r.valid for r in J.json_valid(table(LITERALS, "json")).orderBy("doc_id").collect()]
    assert got == [strict(t) for t in LITERALS]


def random_value(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.3:
        return {rng.choice(['a', 'b\n', 'c"', "é", "{"]) + str(i): random_value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    if depth < 4 and kind < 0.6:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, -2.5, True, None, "x", "{[,:", 'q"', "\\", ""])


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_documents(table, seed):
    rng = random.Random(seed)
    texts = []
    for i in range(800):
        text = json.dumps(random_value(rng), ensure_ascii=False)
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", ",", "]", "}", "{", '"', ":", " x"]) + text[at + rng.randint(0, 1) :]
        texts.append(text)
    df = table(texts, "json")
    for r in df.join(J.json_pretty(df), "doc_id").collect():
        assert r.valid == strict(r.json), r.json
        assert r.pretty == (json.dumps(json.loads(r.json), indent=2, ensure_ascii=False) if r.valid else None), r.json
    chunks = {}
    for r in J.split_json(df).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r.doc_id, []).append((r.key, r.title, r.content))
    for i, text in enumerate(texts):
        expected = []
        if strict(text):
            value = json.loads(text)
            items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else [("value", value)]
            for key, item in items:
                names = (f"item_{key}", f"[{key}]") if isinstance(value, list) else (key, key)
                expected.append((*names, json.dumps(item, indent=2, ensure_ascii=False)))
        assert chunks.get(i, []) == expected, text


def test_members_keep_order_duplicates_and_text(table):
    rows = J.split_json(table(['{"b": 1.00, "2": [], "b": {"x": 1e5}, "k\\u00e9": "\\/"}'], "json")).orderBy("chunk_index").collect()
    assert [(r.key, r.content) for r in rows] == [("b", "1.00"), ("2", "[]"), ("b", '{\n  "x": 1e5\n}'), ("ké", '"\\/"')]


def test_roots(table):
    df = table(['{"a":1}', "[1]", "1"], "json")
    assert [r.doc_id for r in J.split_json(df, roots=["array"]).collect()] == [1]


def test_running_sums(spark):
    for n in (0, 1, 32, 33, 1024, 1025, 33_000):
        values = [i % 5 - 2 for i in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v"))).first()[0]
        assert got == list(accumulate(values)), n


def test_validity_at_any_depth(table):
    deep = [f"{o * d}{inner}{c * e}" for o, c in ("[]", ('{"a":', "}")) for d in (31, 32, 33, 60) for e in (d - 1, d, d + 1) for inner in ("1", '"a":1', "[1,2]", '{"a"}')]
    deep += ["[" * 40 + "1" + "]" * 39 + "}", "[" * 40 + "1," + "]" * 40, "[" * 40 + "1, 2" + "]" * 40, "[" * 40 + "]" * 40 + "[]"]
    got = [r.valid for r in J.json_valid(table(deep, "json")).orderBy("doc_id").collect()]
    assert got == [strict(t) for t in deep]


@pytest.mark.parametrize("job", [J.json_valid, J.json_pretty, J.split_json])
def test_documents_are_not_sorted(table, plan, job):
    """Rows of tokens, their sorts and windows were what spilled and what a task held."""
    assert not re.search(r"Sort|Window|Aggregate", plan(job(table(["[1]"], "json"))))
