"""Every registered query against its SQL, on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from docpipe.queries.oracle import ORACLES
from docpipe.queries.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=key)
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 50
