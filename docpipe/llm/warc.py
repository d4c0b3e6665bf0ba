"""WARC archives: one gzip member per record, written by tasks and read in byte ranges.

A reading task scans its range for the first bytes of a gzip member, takes a candidate for a member if it decodes to a
record's header and other records follow it up to the end of the range, and goes on from member to member. It owns
the records that start inside its range and reads beyond the end for the last of them, up to the header of the next.
Where the chain of the first candidate breaks, the records are followed from the start of the file: a damaged file
fails. So files of any size are read by any number of tasks, without an index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import scratch, table, written

SPLIT = 8 << 20
#: Payloads of at least this many bytes may be replaced by a reference to an equal one.
SMALLEST_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
RECORD = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(head: list[tuple[str, str | None]], content: bytes) -> bytes:
    """A gzip member of a record. Headers without value are left out; line ends cannot stand in a value."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', '%0D%0A', v)}" for k, v in head if v is not None]
    record = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def revisits(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """Add _refers_to to (page_id, url, payload): the page that has an equal payload, or null for responses.

    Of pages with equal payloads the largest page_id is the response, and so are repeated rows of it. Pages without a
    page_id refer to it too; if none has one, all are responses.
    """
    keyed = pages.withColumn("_key", F.when(F.octet_length("payload") >= smallest, F.sha2("payload", 256)))
    last = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.max("page_id").alias("_last"))
    # One payload may have any share of the pages: both sides are shuffled, and a hot key is split at run time.
    joined = keyed.join(last, "_key", "left").drop("_key")
    return joined.withColumn("_refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))).drop("_last")


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, payload, _refers_to) to a file per task in a shared folder; (path, bytes, records) of each.

    A file has a name of its own per attempt and is in the list only if its task succeeded; what a lost executor left
    is not read. Null payloads are empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count = None, None, 0, 0
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/{uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                    size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid4()}>"), ("WARC-Date", date)], b"format: WARC File Format 1.1\r\n"))
                payload = row["payload"] or b""
                again = row["_refers_to"]
                head = [
                    ("WARC-Type", "response" if again is None else "revisit"),
                    ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"),
                    ("WARC-Target-URI", row["url"]),
                    ("WARC-Date", date),
                    ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
                    ("WARC-Profile", None if again is None else PROFILE),
                    ("WARC-Refers-To", None if again is None else f"<urn:page:{again}>"),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                size += out.write(_member(head, _http(len(payload)) + (payload if again is None else b"")))
                count += 1
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    files = pages.select("page_id", "url", "payload", "_refers_to").mapInArrow(write, "path string, bytes long, records long")
    prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    return written(files.withColumn("path", F.concat(F.lit(prefix), "path")), "files")


# --- reading


class Member:
    """A gzip member from a place of a file on: its bytes, and where it ends. Fails if it is none or is cut off."""

    def __init__(self, file, at: int):
        self.file, self.at, self.read = file, at, 0
        self.unpack = zlib.decompressobj(31)

    def some(self) -> bytes:
        """The next bytes; nothing at the end of the member."""
        while not self.unpack.eof:
            raw = self.file.read_at(STEP, self.at + self.read)
            if not raw:
                raise EOFError("member is cut off")
            self.read += len(raw)
            if found := self.unpack.decompress(raw):
                return found
        return b""

    def all(self) -> bytes:
        return b"".join(iter(self.some, b""))

    @property
    def end(self) -> int:
        return self.at + self.read - len(self.unpack.unused_data)


def _is_record(file, at: int) -> bool:
    """Whether a member with a record's header starts here. A header may have any length."""
    if file.read_at(3, at) != MAGIC:
        return False
    member, seen = Member(file, at), bytearray()
    try:
        while more := member.some():
            before = max(0, len(seen) - 3)
            seen += more
            if not b"warc/1.".startswith(seen[:7].lower()):
                return False
            if seen.find(b"\r\n\r\n", before) >= 0:
                break
    except (zlib.error, EOFError):
        return False
    head = seen.partition(b"\r\n\r\n")[0].lower()
    return head.startswith(b"warc/1.") and b"\ncontent-length:" in head and b"\nwarc-type:" in head


def _after(file, at: int) -> int:
    """Where the record that starts here ends. Fails if there is none, or not all of it."""
    if not _is_record(file, at):
        raise ValueError(f"no record at byte {at}")
    member = Member(file, at)
    try:
        while member.some():
            pass
    except (zlib.error, EOFError) as e:
        raise ValueError(f"broken record at byte {at}") from e
    return member.end


def _is_chained(file, size: int, at: int, end: int) -> bool:
    """Whether records follow one another from here to the end of the range or of the file.

    This tells records from those of an archive that stands uncompressed inside a payload: their chain breaks where
    the payload ends.
    """
    try:
        while at < min(end, size):
            at = _after(file, at)
    except ValueError:
        return False
    return True


def _first(file, size: int, start: int, end: int) -> int | None:
    """Where the first record at or after start begins, if that is before end."""
    if start == 0:
        return 0
    at = start
    while at < end:
        block = file.read_at(min(1 << 20, end - at) + len(MAGIC) - 1, at)
        found = block.find(MAGIC)
        while found >= 0:
            if at + found < end and _is_record(file, at + found):
                return at + found if _is_chained(file, size, at + found, end) else _followed(file, start, end)
            found = block.find(MAGIC, found + 1)
        at += 1 << 20
    return None


def _followed(file, start: int, end: int) -> int | None:
    """As _first, by following the records from the start of the file; fails where they break before the range.

    A chain that breaks is of an archive inside a payload or of a damaged file: only the start of the file can tell.
    """
    at = 0
    while at < start:
        at = _after(file, at)
    return at if at < end else None


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    content = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type")
    payload, length = content, len(content)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = content.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
        length = int(said[1]) if kind == "revisit" and said else len(payload)
    digest = fields.get("warc-payload-digest", "")
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_type": kind,
        "record_id": bare(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        # What is there is digested anew; only a reference has to be believed.
        "payload_digest": digest.removeprefix("sha1:") if kind == "revisit" else base32_sha1(payload),
        "payload_bytes": length,
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload": payload if kind != "revisit" else None,
    }


def records(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records of a file that start in [start, end). A file that holds anything but records one after another fails.

    Whatever stands behind the last good record of a file is met by the range that has this record.
    """
    at = first = _first(file, size, start, end)
    while at is not None and at < end:
        if not _is_record(file, at):
            raise ValueError(f"no record at byte {at}")
        member = Member(file, at)
        try:
            record = member.all()
        except (zlib.error, EOFError) as e:
            raise ValueError(f"broken record at byte {at}") from e
        yield parse(record)
        at = member.end
    if first is not None and first < end <= at < size and not _is_record(file, at):
        raise ValueError(f"no record at byte {at}")


_SCHEMA = pa.schema(
    [(k, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for k, t in (x.split() for x in RECORD.split(", "))]
)


def read_warc(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of the files (path, bytes), read in ranges of `split` bytes. No files give no records."""
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    spread = max(1, files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(part["path"])
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for record in records(file, part["bytes"], part["start"], min(part["start"] + split, part["bytes"])):
                        rows.append(record)
                        held += len(record["payload"] or b"")
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return ranges.repartition(int(min(spread, 100_000))).mapInArrow(read, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    files = write_warc(revisits(pages), f"{scratch(spark)}/warc")
    found = read_warc(files).filter("record_type IN ('response', 'revisit')")

    def page(column: str):
        return F.regexp_replace(column, "^urn:page:", "").try_cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
        string_agg_bits AS bits FROM (
            SELECT *, list_aggregate(list_transform(range(40), lambda i:
                lpad(bin(instr('0123456789abcdef', substr(sha1(html), i + 1, 1)) - 1), 4, '0')), 'string_agg', '') AS string_agg_bits FROM p)
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
        + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d
"""
