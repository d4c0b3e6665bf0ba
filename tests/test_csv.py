import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docpipe.functions import csv as C
from docpipe.operators import csv_cells as O


def scan(text):
    """One character at a time."""
    rows, row, field, quoted, i = [], [], "", False, 0
    while i < len(text):
        ch = text[i]
        if ch == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            else:
                quoted = not quoted
        elif quoted or ch not in ",\r\n":
            field += ch
        elif ch == ",":
            row, field = [*row, field], ""
        elif ch == "\n":
            rows, row, field = [*rows, [*row, field]], [], ""
        i += 1
    return [*rows, [*row, field]] if field or row else rows


LITERALS = ["a,", "a\n", 'a\n""', '"x,', 'a"b,c"d', "", "\n\na", "a,b\nc", 'x"\r\n"y\r\n', '"""', '""""', "\r", ","]


def test_rows_of_literals(apply):
    assert apply(LITERALS, C.csv_rows(F.col("v"))) == [scan(t) for t in LITERALS]
    assert scan("a,") == [["a", ""]] and scan('a\n""') == [["a"]] and scan('"x,') == [["x,"]]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_rows_equal_scan(apply, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice('ab",\n\r"') for _ in range(rng.randint(0, 16))) for _ in range(3_000)]
    assert apply(texts, C.csv_rows(F.col("v"))) == [scan(t) for t in texts]


def test_cells_equal_rows(table):
    cells = {}
    for r in O.csv_cells(table(LITERALS, "csv")).collect():
        cells[r.doc_id, r.row_idx, r.col_idx] = r.value
    expected = {(d, i, j): v for d, t in enumerate(LITERALS) for i, row in enumerate(scan(t)) for j, v in enumerate(row)}
    assert cells == expected


def test_markdown(table):
    df = table(["\n\nh,i\n1\n2,3,4\n", "", " \n ", "only"], "csv")
    got = [r.markdown for r in O.csv_to_markdown(df).orderBy("doc_id").collect()]
    assert got[0] == "| h | i |  |\n| --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |"
    assert got[1:] == ["", "", "| only |\n| --- |"]


def test_row_groups(table):
    def doc(n):
        return "h\n" + "".join(f"{i}\n" for i in range(1, n + 1))

    rows = O.split_csv(table([doc(100), doc(101), doc(250), "\n" + doc(100)], "csv")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.key) for r in rows] == [
        (1, "rows_1_100"), (1, "rows_101_101"), (2, "rows_1_100"), (2, "rows_101_200"), (2, "rows_201_250"),
        (3, "rows_1_100"), (3, "rows_101_101"),
    ]
    assert rows[1].title == "rows 101-101" and rows[1].content == "| h |\n| --- |\n| 101 |"
    # A leading blank line is the header: only conversion trims.
    assert rows[5].content.startswith("|  |\n| --- |\n| h |")


def test_shape(table):
    got = [tuple(r)[1:] for r in O.csv_shape(table(["a,b\n1", "", "x\n1,2,3"], "csv")).orderBy("doc_id").collect()]
    assert got == [(2, 2, 2), (0, 0, 0), (2, 3, 1)]
