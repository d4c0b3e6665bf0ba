"""Publishing: whole runs only, repeats replace, crashes leave nothing, each input once; the stream does the same."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.plans import ingest
from docpipe.plans.ingest import publish_ingest, stage_all
from docpipe.plans.publish import Run, Store, run_name
from docpipe.plans.retention import compact, expire, live
from docpipe.streaming.ingest import stream_ingest
from tests.conftest import plan_of

TABLES = ["results", "records", "chunks", "originals", "rejects"]
SCHEMA = "url string, status int, content_type string, content_length string, body binary, fetched_at timestamp"


def response(i, content_type="text/plain", status=200, body=b"text"):
    return (f"http://a/{i}", status, content_type, None, body)


ROWS = [
    response(1, body=b"x" * 60),
    response(2, "image/png"),
    response(3, status=404),
    response(4, "application/json", body=b'{"a":'),
    response(5, "text/html", body=b"<h1>T</h1><p>" + b"y " * 50 + b"</p>"),
    response(6, body=None),
    response(7, body=b"z" * 3000),
]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    return df.withColumn("fetched_at", F.lit("2024-01-01 10:00:00").cast("timestamp"))


def content(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in TABLES}


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("store"))
    return publish_ingest(frame(spark, ROWS), base, "day-1", limit=50, size_limit=2000)


def test_each_input_once(published):
    ends = [r["url"] for t in ("results", "rejects") for r in published.read(t).collect()]
    assert sorted(ends) == [f"http://a/{i}" for i in range(1, 8)]
    assert {(r["url"][-1], r["stage"]) for r in published.read("rejects").collect()} == {("3", "status"), ("4", "convert"), ("6", "body"), ("7", "size")}
    (run,) = published.runs().collect()
    assert run["counts"] == {"inputs": 7, "results": 3, "rejects": 4, "records": 3, "chunks": 2, "originals": 1}


def test_repeat_replaces(spark, published):
    before = content(published)
    publish_ingest(frame(spark, ROWS), published.base, "day-1", limit=50, size_limit=2000)
    assert content(published) == before
    assert published.runs().count() == 1
    assert published.remove_unpublished(hours=1) == 0
    assert published.remove_unpublished(hours=-1) == 5
    assert content(published) == before


def test_crash_is_invisible(spark, published, monkeypatch, at="chunks"):
    before = content(published)
    write = Run.write

    def broken(self, table, rows, by=None):
        write(self, table, rows.limit(1) if table == at else rows, by)
        if table == at:
            raise OSError("gone")

    monkeypatch.setattr(Run, "write", broken)
    for run in ("day-1", "day-2"):
        with pytest.raises(OSError):
            publish_ingest(frame(spark, ROWS[:2]), published.base, run, limit=50)
    assert content(published) == before


def test_lost_rows_are_not_published(spark, published, monkeypatch):
    before = content(published)
    whole = ingest.outputs
    monkeypatch.setattr(ingest, "outputs", lambda *a: (t := whole(*a)) | {"results": t["results"].limit(1)})
    with pytest.raises(RuntimeError, match="7 responses gave 1 results and 4 rejects"):
        publish_ingest(frame(spark, ROWS), published.base, "day-1", limit=50, size_limit=2000)
    assert content(published) == before


def test_runs_side_by_side(spark, tmp_path):
    base = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no run"):
        Store(spark, base).read("results")
    publish_ingest(frame(spark, ROWS[:1]), base, "a day/with: odd name")
    store = publish_ingest(frame(spark, ROWS[1:2]), base, "0")
    publish_ingest(frame(spark, []), base, "nothing")
    assert sorted(r["url"] for r in store.read("results").collect()) == ["http://a/1", "http://a/2"]
    assert store.read("records").schema["fetched_date"].dataType.simpleString() == "date"
    assert store.runs().count() == 3


def test_names():
    assert run_name("day-1.x") == "day-1.x"
    assert len({run_name(n) for n in ("a/b", "../x", "", "_x", ".x", "a b")}) == 6
    assert all("/" not in run_name(n) and run_name(n)[0].isalnum() for n in ("a/b", "../x", "", "_x", ".x"))


def test_rejects_need_no_bodies(spark, tmp_path):
    """The responses are read by the staging pass only; rejects come from their own partition of what it wrote."""
    source = str(tmp_path / "in")
    frame(spark, ROWS).write.parquet(source)
    staged, n = stage_all(spark.read.parquet(source), str(tmp_path / "staged"))
    assert n == 7
    tables = ingest.outputs(staged, str(tmp_path), None, False, 50)
    for rows in tables.values():
        assert f"{source}" not in plan_of(rows)
    rejects = plan_of(tables["rejects"])
    assert "kind#" in rejects and "= rejected" in rejects
    assert staged.filter("kind = 'rejected' AND body IS NOT NULL").count() == 0


def test_stream(spark, tmp_path, monkeypatch):
    """Three files, two batches a run; one batch fails between its tables and is run again."""
    source = tmp_path / "in"
    for i in range(3):
        frame(spark, ROWS[i * 2 : i * 2 + 3]).coalesce(1).write.mode("append").parquet(str(source))
    batch = publish_ingest(spark.read.parquet(str(source)), str(tmp_path / "batch"), "all", limit=50)

    def start():
        stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).option("maxFilesPerTrigger", 2).parquet(str(source))
        return stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), limit=50)

    calls = []
    write = Run.write

    def broken(self, table, rows, by=None):
        calls.append(table)
        if len(calls) == 8:
            raise OSError("gone")
        return write(self, table, rows, by)

    with monkeypatch.context() as patch:
        patch.setattr(Run, "write", broken)
        with pytest.raises(Exception, match="gone"):
            start().awaitTermination()
    assert Store(spark, str(tmp_path / "out")).runs().count() == 1
    start().awaitTermination()
    start().awaitTermination()
    store = Store(spark, str(tmp_path / "out"))
    assert store.runs().count() == 2
    assert content(store) == content(batch)


def test_retention(spark, tmp_path, monkeypatch):
    """Old responses leave all tables at once, by the log first, then for good; crashes change nothing that is read."""
    base = str(tmp_path / "store")
    old = frame(spark, ROWS)
    new = frame(spark, ROWS).withColumn("fetched_at", F.lit("2024-01-20 10:00:00").cast("timestamp"))
    unknown = frame(spark, ROWS[:2]).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    store = publish_ingest(old.unionByName(new), base, "both", limit=50, size_limit=2000)
    publish_ingest(unknown, base, "unknown", limit=50)

    def seen():
        drop = ["fetched_at", "created_at", "expires_at", "fetched_date"]
        return {t: sorted(map(str, live(store, t).drop(*drop).collect())) for t in TABLES}

    kept = {t: store.read(t).filter(~F.col("created_at" if t == "chunks" else "fetched_at").eqNullSafe(F.lit("2024-01-01 10:00:00").cast("timestamp"))) for t in TABLES}
    expected = {t: sorted(map(str, rows.drop("fetched_at", "created_at", "expires_at", "fetched_date").collect())) for t, rows in kept.items()}
    assert expire(store, datetime(2024, 2, 5)) == 7
    assert seen() == expected and store.read("results").count() == 8
    write = Run.write

    def broken(self, table, rows, by=None):
        write(self, table, rows, by)
        if table == "chunks":
            raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(Run, "write", broken)
        with pytest.raises(OSError):
            compact(store)
    assert seen() == expected
    with monkeypatch.context() as patch:
        patch.setattr(Store, "withdraw", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            compact(store)
    assert seen() == expected
    assert compact(store) == 1 and compact(store) == 0
    assert seen() == expected and store.read("results").count() == 5
    # Responses without a time are as old as their files.
    tomorrow = datetime.now() + timedelta(days=31)
    assert expire(store, tomorrow, days=32) == 7
    assert expire(store, tomorrow, days=30) == 9
    assert all(live(store, t).isEmpty() for t in TABLES)
