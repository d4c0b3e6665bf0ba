import gzip
import io
import random
import zlib

import pyarrow as pa
import pytest

from docpipe.llm.common import scratch
from docpipe.llm.warc import _member, base32_sha1, read_warc, records, revisits, write_warc

PAGES = [(1, "http://a", b"same"), (2, "http://b", b"same"), (3, None, b""), (4, "x\r\ny: z", b""), (5, "u", bytes(range(256)) * 300), (6, "é", b"alone"), (None, "n", b"alone"), (7, "t", b"tw"), (7, "t", b"tw"), (8, "v", None)]


@pytest.fixture
def files(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, payload binary").selectExpr("page_id", "url", "coalesce(payload, X'') AS payload")
    return write_warc(revisits(pages), f"{scratch(spark)}/warc")


@pytest.mark.parametrize("split", [1 << 20, 97])
def test_round_trip(files, split):
    rows = [r for r in read_warc(files, split).collect() if r.record_type != "warcinfo"]
    assert len(rows) == len(PAGES) == sum(r.records for r in files.collect())
    by = {r.record_id: r for r in rows}
    assert (by["urn:page:1"].record_type, by["urn:page:1"].refers_to, by["urn:page:1"].payload_bytes) == ("revisit", "urn:page:2", 4)
    assert by["urn:page:1"].payload_digest == base32_sha1(b"same") == by["urn:page:2"].payload_digest
    assert by["urn:page:3"].refers_to == "urn:page:8" and by["urn:page:8"].payload_bytes == 0
    assert by["urn:page:5"].payload == bytes(range(256)) * 300 and by["urn:page:6"].target_uri == "é"
    assert by["urn:page:None"].refers_to == "urn:page:6"
    assert [r.record_type for r in rows if r.record_id == "urn:page:7"] == ["response"] * 2


def test_files_are_plain_gzip(files):
    for f in files.collect():
        with gzip.open(f.path.removeprefix("file://")) as file:
            assert file.read().count(b"WARC/1.1\r\n") >= f.records + 1


def test_every_split_of_a_file_with_an_archive_inside():
    """A payload that holds an archive uncompressed, and bytes that look like a member, are not taken for records."""
    inner = b"".join(_member([("WARC-Type", "response"), ("WARC-Record-ID", f"<in{i}>")], b"inner") for i in range(2))
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <outer>\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(record) + stored.flush()
    data = _member([("WARC-Type", "response"), ("WARC-Record-ID", "<first>")], b"\x1f\x8b\x08" * 50) + outer + _member([("WARC-Type", "response"), ("WARC-Record-ID", "<last>")], b"x")

    class File(io.BytesIO):
        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    file = File(data)
    for cut in range(1, len(data), 7):
        found = [r["record_id"] for a, b in ((0, cut), (cut, len(data))) for r in records(file, len(data), a, b)]
        assert found == ["first", "outer", "last"]


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def read_all(data, split):
    return [r for a in range(0, len(data), split) for r in records(Bytes(data), len(data), a, min(a + split, len(data)))]


def members(n, extra=()):
    return [_member([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>"), *extra], b"%d" % (i * 7919) * 50) for i in range(n)]


SPLITS = [100, 150, 333, 700, 1000, 1 << 20]


@pytest.mark.parametrize("split", SPLITS)
def test_damaged_files_fail_at_every_split(split):
    """Cut off, with bytes behind the last record, with a damaged record or something else between: never fewer records."""
    good = members(12)
    whole = b"".join(good)
    assert [r["record_id"] for r in read_all(whole, split)] == [f"r{i}" for i in range(12)]
    at = len(b"".join(good[:6]))
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = other.compress(b"no record") + other.flush()
    damaged = [whole[:-k] for k in (1, 9, len(good[-1]) - 5)]
    damaged += [whole + b"tail", whole + b"\0" * 900, b"x" + whole, whole[:at] + other + whole[at:]]
    damaged += [whole[: at + k] + b"\xff" * 20 + whole[at + k + 20 :] for k in (0, 40)]
    for data in damaged:
        with pytest.raises(ValueError):
            read_all(data, split)


@pytest.mark.parametrize("split", [100_000, 1 << 20, 1 << 23])
def test_headers_of_any_length(split):
    """A header above 1 MiB, with records before and behind it."""
    url = "http://a/" + random.Random(1).randbytes(3 << 19).hex()
    data = b"".join(members(5) + members(1, [("WARC-Target-URI", url)]) + members(5))
    found = read_all(data, split)
    assert len(found) == 11 and [r["target_uri"] for r in found] == [None] * 5 + [url] + [None] * 5


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, payload binary")
    assert read_warc(write_warc(revisits(none), f"{scratch(spark)}/warc")).count() == 0
    assert pa.types.is_binary(pa.binary())
