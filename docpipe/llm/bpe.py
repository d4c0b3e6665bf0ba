"""Byte-pair encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts every text where its own bytes say so, hence equal passages fall into equal chunks wherever they
stand. Chunks that occur more than once in the table are encoded once. A cut may fall inside a word: a chunk is encoded
without the parts of words at its two ends, and where chunks meet, the word across the join is put together and
encoded again, so that the ids agree with those of the whole text.

Texts all of whose chunks are unique are encoded where they are read and never shuffled. Which chunks recur is known
from a count of narrow hashes; tasks look it up in a bitmap of bounded size (a Bloom filter), whose rare false
positives only send a text the longer way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import groupby
from operator import itemgetter
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, written
from docpipe.llm.tokens import WordEncoder
from docpipe.llm.words import blocks, mix

#: A chunk ends where this many low bits of the rolling hash are zero: 1 KiB on average.
CHUNK_BITS = 10
#: Bits of the bitmap per recurring chunk, and its limits (128 KiB and 32 MiB).
BITS_PER_CHUNK = 16
SMALLEST_BITMAP, LARGEST_BITMAP = 1 << 20, 1 << 28

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Offsets at which chunks of each UTF-8 text of a block start and the last one ends, given by the 32 bytes before.

    The rolling hash is the sum of a value per byte, shifted by its distance; sums over 2, 4, 8, 16 and 32 bytes are
    made for all offsets at once. The window lies inside the text, and a cut never falls inside a code point.
    """
    rolled = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        if len(rolled) > span:
            rolled[span:] = rolled[span:] + (rolled[:-span] << np.uint32(span))
    ends = np.flatnonzero((rolled >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    text = np.searchsorted(offsets, ends, side="right") - 1
    inside = (ends - offsets[text] >= 32) & (ends < offsets[text + 1])
    ends, text = ends[inside], text[inside]
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    return [
        [int(offsets[d]), *ends[bounds[d] : bounds[d + 1]].tolist(), int(offsets[d + 1])] if offsets[d] < offsets[d + 1] else []
        for d in range(len(offsets) - 1)
    ]


def block_chunks(data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """The chunks of each text of a block; an empty text has none."""
    raw = data.tobytes()
    return [[raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)] for at in cuts(data, offsets)]


def _key(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in blocks(batch, "text"):
            keys = [_key(c) for own in block_chunks(data, offsets) for c in own]
            yield pa.record_batch({"key": pa.array(keys, pa.binary())})


class Bitmap:
    """Keys that may recur. Each key sets two bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def size(keys: int) -> int:
        wanted = 1 << max(0, (keys * BITS_PER_CHUNK - 1).bit_length())
        return min(max(wanted, SMALLEST_BITMAP), LARGEST_BITMAP)

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> Bitmap:
        """From the column key; Spark unites the bits, the driver gets the words of the bitmap."""
        bits = cls.size(n)
        halves = keys.select(F.explode(F.array(F.substring("key", 1, 8), F.substring("key", 9, 8))).alias("half"))
        place = F.pmod(F.conv(F.hex("half"), 16, 10).cast("decimal(20,0)"), F.lit(bits)).cast("long")
        united = halves.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
        words = np.zeros(bits // 64, np.int64)
        found = united.toArrow()
        words[found.column("word").to_numpy()] = found.column("set").to_numpy()
        return cls(words.view(np.uint64))

    def has(self, keys: list[bytes]) -> np.ndarray:
        halves = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64) % np.uint64(len(self.words) * 64)
        there = (self.words[(halves >> np.uint64(6)).astype(np.int64)] >> (halves & np.uint64(63))) & np.uint64(1)
        return there.reshape(-1, 2).all(axis=1)


# --- encoding


def _ends(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
    """(part of a word before the first white space, what lies between, part of a word after the last white space).

    Without white space the chunk is all one part, and there is no between.
    """
    parts = chunk.split(None, 1) if not chunk[:1].isspace() else [b"", chunk]
    if len(parts) == 1:
        return (chunk, None, b"") if not chunk[-1:].isspace() else (chunk.rstrip(), b"", b"")
    head = parts[0]
    rest = chunk[len(head) :]
    if rest[-1:].isspace():
        return head, rest, b""
    tail = rest.split()[-1]
    return head, rest[: len(rest) - len(tail)], tail


def encoded_part(chunk: bytes, ids: bytes) -> dict:
    head, between, tail = _ends(chunk)
    return {"head": head, "spaced": between is not None, "tail": tail, "ids": _PACK.compress(ids)}


def encode_parts(encoder: WordEncoder, chunks: list[bytes]) -> list[dict]:
    """head, spaced, tail and the packed ids of what lies between, for each chunk."""
    found = encoder.ids([_ends(c)[1] or b"" for c in chunks])
    return [encoded_part(c, ids) for c, ids in zip(chunks, found, strict=True)]


def join_parts(encoder: WordEncoder, texts: list[list[dict]]) -> list[tuple[bytes, bytes]]:
    """Ids and decoded text of each text from its parts in order.

    The word across each join is encoded as a whole; a part without white space only lengthens it.
    """
    joins: list[bytes] = []
    orders: list[list[bytes | int]] = []
    for parts in texts:
        order: list[bytes | int] = []
        word: list[bytes] = []
        for p in parts:
            word.append(p["head"])
            if p["spaced"]:
                order += [len(joins), _UNPACK.decompress(p["ids"])]
                joins.append(b"".join(word))
                word = [p["tail"]]
        order.append(len(joins))
        joins.append(b"".join(word))
        orders.append(order)
    again = encoder.ids(joins)
    out = []
    for order in orders:
        ids = b"".join([again[x] if isinstance(x, int) else x for x in order])
        out.append((ids, encoder.decode(ids)))
    return out


def _digest(doc, ids: bytes, text: bytes) -> tuple:
    return doc, len(ids) // 4, sha256(ids).hexdigest(), sha256(text).hexdigest()


_RESULT = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_PART = {"head": pa.binary(), "spaced": pa.bool_(), "tail": pa.binary(), "ids": pa.binary()}
_SENT = {"row": pa.binary(), "place": pa.int64(), "key": pa.binary(), "chunk": pa.binary()}
_PART_SQL = "head binary, spaced boolean, tail binary, ids binary"


def _results(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema({"doc_id": kind} | _RESULT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, schema.types, strict=True)], schema=schema)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, SHA-256 of the ids and of the decoded text.

    Null and empty texts have no tokens. Repeated rows each have their row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_column).alias("doc_id"), body(text_column).alias("text"))
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.select("text").mapInArrow(_chunk_keys, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    recurring = written(counted.filter("n > 1").select("key"), "recurring")
    bitmap = spark.sparkContext.broadcast(Bitmap.of(recurring, recurring.count()))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of texts without recurring chunks. Of the others, under a name of their row: chunks that may recur,
        and what lies between them already encoded."""
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            schema = pa.schema({"doc_id": batch.schema.field("doc_id").type} | _RESULT | _SENT | _PART)
            for part, data, offsets in blocks(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                alone, whole, sent, own = [], [], [], []
                for doc, chunks in zip(ids, block_chunks(data, offsets), strict=True):
                    keys = [_key(c) for c in chunks]
                    shared = bitmap.value.has(keys).tolist() if keys else []
                    if not any(shared):
                        alone.append(doc)
                        whole.append(b"".join(chunks))
                        continue
                    row = uuid4().bytes
                    for place, (again, run) in enumerate(groupby(zip(shared, keys, chunks, strict=True), key=itemgetter(0))):
                        if again:
                            sent += [{"doc_id": doc, "row": row, "place": place << 32 | i, "key": k, "chunk": c} for i, (_, k, c) in enumerate(run)]
                        else:
                            own.append(({"doc_id": doc, "row": row, "place": place << 32}, b"".join([c for _, _, c in run])))
                done = [_digest(doc, *x) for doc, x in zip(alone, encoder.encode(whole), strict=True)]
                sent += [name | p for (name, _), p in zip(own, encode_parts(encoder, [c for _, c in own]), strict=True)]
                sent += [dict(zip(("doc_id", *_RESULT), x, strict=True)) for x in done]
                yield pa.RecordBatch.from_pylist(sent, schema)

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        schema = pa.schema({"key": pa.binary()} | _PART)
        for batch in batches:
            for part, _, _ in blocks(batch, "chunk"):
                found = encode_parts(encoder, part.column("chunk").to_pylist())
                yield pa.RecordBatch.from_pylist([{"key": k} | p for k, p in zip(part.column("key").to_pylist(), found, strict=True)], schema)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = join_parts(encoder, part.column("parts").to_pylist())
                yield _results([_digest(d, *x) for d, x in zip(part.column("doc_id").to_pylist(), found, strict=True)], batch.column("doc_id").type)

    result = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    passed = written(rows.mapInArrow(first_pass, f"doc_id {doc_kind}, {result}, row binary, place long, key binary, chunk binary, {_PART_SQL}"), "passed")
    recurs = passed.filter("key IS NOT NULL")
    encoded = written(recurs.select("key", "chunk").dropDuplicates(["key"]).mapInArrow(encode_chunks, f"key binary, {_PART_SQL}"), "encoded")
    # A chunk may stand in any number of texts: a plain join of two shuffles, split at run time where a key is hot.
    columns = ("doc_id", "row", "place", "head", "spaced", "tail", "ids")
    placed = recurs.select("doc_id", "row", "place", "key").join(encoded, "key").select(*columns)
    placed = placed.unionByName(passed.filter("row IS NOT NULL AND key IS NULL").select(*columns))
    whole = placed.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("place", "head", "spaced", "tail", "ids"))).alias("parts"))
    joined = whole.select("doc_id", "parts").mapInArrow(put_together, f"doc_id {doc_kind}, {result}")
    return passed.filter("row IS NULL").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(joined)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
