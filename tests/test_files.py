"""Files in many blocks against the same text in one cell."""

import random

import pytest
from pyspark.sql import functions as F

from docpipe.operators.csv_cells import csv_cells, split_csv
from docpipe.operators.csv_files import csv_file_cells, csv_file_groups, csv_file_records
from docpipe.operators.json_files import split_json_files
from docpipe.operators.json_tokens import split_json
from docpipe.sources.pieces import read_pieces, runs_of_pieces

EDGES = ["", "\n", "\n\n", "a", "a\n", "a\n\n", 'a\n""', 'a\n""\n', "a,", "a,b\n1,2\n", 'a,"x\ny",b\n"\n\n",2\n', '"open\nto the end\n', '"open\n', 'x"y\nz"w\n1', "﻿a,b\n1,2", "﻿a\n", "\r\n a\r\n", '"a""b"\n"""\n"""']


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "64")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def texts():
    rng = random.Random(7)
    drawn = ["".join(rng.choice(['"', '"', ",", "\n", "\n", "a", "é", "bc", "\r", "x" * 30]) for _ in range(rng.randrange(200))) for _ in range(40)]
    return [*EDGES, *drawn]


def write(folder, values, suffix="csv"):
    for i, text in enumerate(values):
        (folder / f"doc={i}").mkdir(parents=True)
        (folder / f"doc={i}" / f"a.{suffix}").write_bytes(text.encode())
    return str(folder)


def test_cells(spark, table, tmp_path, small_blocks):
    values = texts()
    got = csv_file_cells(spark, write(tmp_path / "in", values)).drop("file").collect()
    expected = csv_cells(table(values, "csv")).collect()
    for i, text in enumerate(values):
        mine, theirs = (sorted(tuple(r)[1:] for r in rows if r[0] == i) for rows in (got, expected))
        assert mine == theirs, (i, text)


def test_groups(spark, table, tmp_path, small_blocks):
    values = ["h,i\n" + "".join(f'{i},"a\nb{i}"\n' + ("x\n" if i % 9 == 0 else "") for i in range(n)) for n in (5, 95, 230)]
    records = csv_file_records(spark, write(tmp_path / "in", values))
    got = sorted(tuple(r) for r in csv_file_groups(records).drop("file").collect())
    assert got == sorted(tuple(r) for r in split_csv(table(values, "csv")).collect())
    assert len({r[0] for r in got}) == 2


def test_many_tasks(spark, tmp_path, small_blocks):
    path = write(tmp_path / "in", ["a,b\n" * 2000])
    assert spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start")).distinct().count() > 100
    assert csv_file_records(spark, path).agg(F.max("row_idx")).first()[0] == 1999


JSON = [
    "[]", " [ ] ", "{}", '""', "5", " true ", "", "[", "]", "{", "[1]", "[1,2]", "[1,,2]", "[1,]", "[,1]", "[1],[2]", "1,2", '"a,b"', "[1,2],",
    '{"a":1,"b":[1,{"c":"x,]}"}],"a":null}', '["a\\",b","\\\\",",","]"]', '[1,"\\,"]', '["open, 1]', '{"a" 1}', '{"a":1,2}', '["}",{"[":"{"},[],{}]',
    '[[1,2],[3,[4,5]],{"k,":[6,7]}]', "﻿[1]", "[1}", "{1]", "[1 2,3]", '\n[\n  {"é": "😀,\\u00e9"},\n  "x"\n]\n', "[" + ",".join(f'{{"id": {i}, "s": "a,{i}"}}' for i in range(300)) + "]",
    "{" + ",".join(f'"k{i}": [{i}, "]"]' for i in range(100)) + "}",
]


def test_json(spark, table, tmp_path, small_blocks):
    rng = random.Random(3)
    drawn = ["[" + "".join(rng.choice(['"', ",", ",", "[", "]", "{", "}", ":", "1", '"a"', "\\", " "]) for _ in range(rng.randrange(12))) + "]" for _ in range(60)]
    values = [*JSON, *drawn]
    got = split_json_files(spark, write(tmp_path / "in", values, "json")).drop("file").collect()
    expected = split_json(table(values, "json")).collect()
    for i, text in enumerate(values):
        mine, theirs = (sorted(tuple(r)[1:] for r in rows if r[0] == i) for rows in (got, expected))
        assert mine == theirs, (i, text)
    assert len({r[0] for r in got}) > 12


def test_pieces_travel_in_runs(spark, tmp_path):
    """Not piece by piece: rows of single pieces were shuffled and sorted again for every sum."""
    path = write(tmp_path / "in", [",".join(f"é{i}" for i in range(1000)), ",,a,", "b"], "json")
    rows = runs_of_pieces(read_pieces(spark, path, ","), ",", 300).select("doc", "piece").collect()
    # The first pieces of a run of numbers may belong to the file before.
    assert 5 <= len(rows) <= 8
    assert sorted(",".join(r.piece for r in rows if r.doc == d) for d in (1, 2)) == [",,a", "b"]
    whole = sorted((r.piece for r in rows if r.doc == 0), key=lambda t: int(t.split(",")[0][1:]))
    assert ",".join(whole) == ",".join(f"é{i}" for i in range(1000))


def test_items_across_runs(spark, table, tmp_path, monkeypatch):
    """Several runs in a block: strings, depth and items go on from one into the next."""
    monkeypatch.setattr(runs_of_pieces, "__defaults__", (3,))
    values = ["[" + ",".join(f'{{"a,\\",{i}": [{i}, ["]", "{{"]], "b": "x,,,,\\\\"}}' for i in range(40)) + "]", '{"k": [1,2,3,4,5,6,7], "l": ",,,,,,", "m": 1}']
    got = split_json_files(spark, write(tmp_path / "in", values, "json")).drop("file").collect()
    expected = split_json(table(values, "json")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) == 43
