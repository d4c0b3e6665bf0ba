import pytest
from pyspark.sql import functions as F

from docpipe.operators import archive as A
from docpipe.operators import audit as E

MEMBERS = [
    ("x", 0, "d/", 0, True, None, False),
    ("x", 1, "d/Über Text.TXT", 5, False, " hello \n", False),
    ("x", 2, "Makefile", 3, False, "all", False),
    ("x", 3, "c", 3, False, "int", False),
    ("x", 4, "empty.md", 1, False, " ", False),
    ("x", 5, "a" * 70 + ".md", 9, False, "y" * 50_010, False),
    ("part", 0, "a.md", 1, False, "z", False),
    ("part", 1, None, None, False, None, True),
    ("lost", 0, None, None, False, None, True),
]
SCHEMA = "archive_id string, entry_index long, entry_name string, size long, is_directory boolean, content string, failed boolean"


@pytest.fixture
def members(spark):
    return spark.createDataFrame(MEMBERS, SCHEMA)


def test_index_counts_directories(members):
    got = {r.archive_id: r.content for r in A.archive_index(members).collect()}
    assert got["x"].startswith("Archive contains 6 files:\n\nd/  (0 B)\nd/Über Text.TXT  (5 B)\nMakefile  (3 B)")
    assert set(got) == {"x", "part"}


def test_member_chunks(members):
    rows = A.archive_member_chunks(members).orderBy("archive_id", "entry_index").collect()
    assert [(r.archive_id, r.key, r.title, len(r.content)) for r in rows] == [
        ("part", "a.md", "a.md", 1),
        ("x", "d_ber_Text.TXT", "d/Über Text.TXT", 5),
        ("x", "c", "c", 3),
        ("x", "a" * 60, "a" * 70 + ".md", 50_010),
    ]


def test_errors_follow_what_was_listed(members):
    errors = {r.archive_id: r.lone for r in A.archive_errors(members).collect()}
    assert errors == {"part": False, "lost": True}
    rows = A.split_archive(members).orderBy("archive_id", "chunk_index").collect()
    keys = {}
    for r in rows:
        keys.setdefault(r.archive_id, []).append(r.key)
    assert keys["part"] == ["index", "a.md", "error"] and keys["lost"] == ["error"]
    assert [r.chunk_index for r in rows if r.archive_id == "x"] == [0, 1, 2, 3]


def test_encoding_issues(table):
    bodies = [b"ok\n", b"\xef\xbb\xbfx", b"a\nb\r\nc\r\n", b"\xff\r", b"only cr\r", b"a\r\n" + b"\xe2\x82"]
    df = E.encoding_issues(table(bodies, "body", "binary")).orderBy("doc_id")
    got = [(r.has_bom, r.crlf_line, r.malformed, r.n_issues) for r in df.collect()]
    assert got == [
        (False, None, False, 0), (True, None, False, 1), (False, 2, False, 1), (False, None, True, 1),
        (False, None, False, 0), (False, 1, True, 2),
    ]
    report = E.encoding_report(table(bodies, "body", "binary")).first()
    assert tuple(report) == (6, 4, 5, False)


def test_candidates(spark):
    paths = {
        "src/a.ts": True, "docs/x/y.md": True, "lib/a.ts": False, "README.md": True, "a.txt": False, "src/node_modules/a": False,
        "src/data.sqlite": False, "tools/x.DB": False, ".git/x": False, "package.json": True, "src/.db": True, "src": False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in E.audit_candidates(df).collect()} == {p for p, keep in paths.items() if keep}
