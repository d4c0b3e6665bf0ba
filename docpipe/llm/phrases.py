"""Collocations: phrases of two to four words that occur together more often than their parts explain.

Texts become blocks of one language. Every run of words of a block gets a Rabin-Karp fingerprint from prefix polynomials.
A block sends each of its fingerprints once, with its number of occurrences and the block as the pointer, packed by
ranges of fingerprints; a shuffle adds them up by range, and each block learns which of its own are frequent: a bit for
each fingerprint it sent, in the order sent. Runs of three and four words are sent only where all runs of two words inside
them are frequent, as they cannot be frequent otherwise. Then the blocks read their frequent phrases from the text, and
these are counted by text, so that colliding fingerprints fall apart: a fingerprint only proposes.

No table of all phrases reaches a task: a block gets only what it holds itself. A block and its bits reach Python as a
group of narrow rows, one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, written
from docpipe.llm.words import mix, words

LONGEST = 4
#: Occurrences of a candidate.
LEAST = 30
#: A phrase goes if a longer one has this many percent of its occurrences.
NESTED = 80
TOP = 2000
SCORE = 2_000_000
UNKNOWN = "und"
#: Bytes of a block; it ends with the piece that reaches this. A task holds up to HELD bytes of unfinished blocks.
BLOCK = 2 << 20
HELD = 64 << 20
#: Words of the corpus for each range of fingerprints, which one call adds up; bytes of a fingerprint within its range.
RANGE_WORDS = 500_000
CELL = 5
#: Parts of a language that are ranked apart before their best are ranked together.
PARTS = 64
#: Bytes of texts that become blocks at a time, and rows of phrases that leave Python at a time.
TAKEN = 4 << 20
PHRASES = 1 << 15
#: Blocks are wide rows: the writer looks at its size after each one, and a reader takes a row group at a time.
NARROW = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)

_SEED = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _count_words(data: bytes) -> int:
    inside = np.frombuffer(data, np.uint8)
    inside = (inside != 32) & (inside != 10)
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of TAKEN bytes of text, one row at least: what is copied of a batch does not grow with it."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        for at in _slices(sizes, TAKEN):
            yield batch.slice(at.start, at.stop - at.start)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text) to blocks (lang, data, n_words): pieces end with a line break, words are parted by blanks."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def blocks(lang: str, all_: bool) -> Iterator[pa.RecordBatch]:
        data = b"".join(held.pop(lang))
        sizes.pop(lang)
        at = 0
        while at < len(data):
            end = data.find(b"\n", at + BLOCK - 1) + 1
            if end == 0 or len(data) - at < BLOCK:
                if not all_:
                    break
                end = len(data)
            part = data[at:end]
            at = end
            if count := _count_words(part):
                yield pa.record_batch({"lang": [lang], "data": pa.array([part], pa.binary()), "n_words": pa.array([count], pa.int64())})
        if at < len(data):
            held[lang], sizes[lang] = [data[at:]], len(data) - at

    for batch in _some(batches):
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column("text").filter(pa.compute.equal(langs.indices, k))
            data = b"\n".join([t.as_buffer() for t in texts] + [b""]).translate(_TABLE)
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= 2 * BLOCK:
                yield from blocks(lang, False)
        if sum(sizes.values()) > HELD:
            for lang in list(held):
                yield from blocks(lang, True)
    for lang in list(held):
        yield from blocks(lang, True)


def text_blocks(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The words of all texts as a table (block, lang, data, n_words)."""
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), body(text_column).alias("text"))
    blocks = rows.mapInArrow(_cut, "lang string, data binary, n_words long")
    return written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", NARROW)


def _words(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and hashes of all words, and the number of words of each piece; some pieces at a time."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for at in _slices(np.diff(offsets)):
        first = offsets[at.start]
        found = words(values[first : offsets[at.stop]], offsets[at.start : at.stop + 1] - first)
        parts.append((found.starts + first, found.ends + first, found.hashes, found.counts))
    starts, ends, hashes, counts = zip(*parts, strict=True)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes), np.concatenate(counts)


class Block:
    """Words and fingerprints of a block."""

    def __init__(self, lang: str, data: bytes) -> None:
        self.raw = data
        values = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(values == 10) + 1
        offsets = np.concatenate(([0], ends if len(ends) and ends[-1] == len(values) else np.append(ends, len(values))))
        self.starts, self.ends, self.hashes, counts = _words(values, offsets)
        self.last = np.repeat(np.cumsum(counts), counts)  # the first word of the next piece, for each word
        self.salt = int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") ^ (len(lang.encode()) * _SEED & (1 << 64) - 1)
        for part in range(8, len(lang.encode()), 8):
            self.salt = (self.salt * _ODD + int.from_bytes(lang.encode()[part : part + 8], "little")) & (1 << 64) - 1
        n = len(self.hashes)
        powers = np.full(n + 1, _ODD, np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers)
        down = np.full(n + 1, _INVERSE, np.uint64)
        down[:1] = 1
        self.down = np.cumprod(down)
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[:n])))

    def runs(self, k: int) -> np.ndarray:
        """Numbers of the words at which a run of k words starts that stays inside its piece."""
        return np.flatnonzero(np.arange(len(self.last)) + k <= self.last)

    def fingerprints(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of the runs of k words from `at` on: a difference of prefix polynomials, moved to power 0."""
        raw = (self.prefix[at + k] - self.prefix[at]) * self.down[at]
        return mix(raw ^ np.uint64((self.salt + k * _SEED) & (1 << 64) - 1)).view(np.int64)

    def same_words(self) -> np.ndarray:
        """A number for each word, equal for equal words and no others: hashes, verified byte by byte."""
        _, first, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        sizes = self.ends - self.starts
        model = first[number]
        if (sizes == sizes[model]).all() and all(self._equal(at, model[at], sizes[at]) for at in _slices(sizes)):
            return number
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(self.raw[s:e], len(known)) for s, e in zip(self.starts, self.ends, strict=True)], np.int64)

    def _equal(self, at: slice, model: np.ndarray, sizes: np.ndarray) -> bool:
        values = np.frombuffer(self.raw, np.uint8)
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return bool((values[np.repeat(self.starts[at], sizes) + inside] == values[np.repeat(self.starts[model], sizes) + inside]).all())


def _slices(sizes: np.ndarray, limit: int = 1 << 18) -> Iterator[slice]:
    """Slices of words with some `limit` bytes each, one word at least."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, stop)
        at = stop


def _distinct(block: Block, at: np.ndarray, k: int, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of occurrences, first word) of the different runs of k words at `at`, whatever their fingerprints."""
    while len(at):
        prints = block.fingerprints(at, k)
        order = np.argsort(prints, kind="stable")
        ordered, places = prints[order], at[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        model = np.repeat(places[heads], np.diff(np.append(heads, len(ordered))))
        same = np.ones(len(places), bool)
        for j in range(k):
            same &= number[places + j] == number[model + j]
        yield np.add.reduceat(same.astype(np.int64), heads), places[heads]
        at = np.sort(places[~same])


def _binary(values: np.ndarray, bounds: np.ndarray, width: int) -> pa.Array:
    """Binary cells of values (rows of `width` bytes) between bounds."""
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(data)])


def _cells(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL]


def _numbers(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in binary cells, and how many each cell has."""
    cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    sizes = pa.compute.binary_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    packed = np.frombuffer(b"".join(c.as_buffer() for c in cells), np.uint8).reshape(-1, CELL)
    wide_ = np.zeros((len(packed), 8), np.uint8)
    wide_[:, :CELL] = packed
    return wide_.view("<u8").ravel().astype(np.uint64), sizes // CELL


def _sorted_set(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]))]


class Ranges:
    """2**bits ranges of fingerprints. A fingerprint in its range keeps 8 * CELL bits; what that merges only proposes more."""

    def __init__(self, bits: int) -> None:
        self.bits = bits

    def short(self, prints: np.ndarray) -> np.ndarray:
        return prints.view(np.uint64) >> np.uint64(64 - 8 * CELL - self.bits)

    def packed(self, prints: np.ndarray, k: int, block: int, least: int) -> pa.RecordBatch:
        """A row per range: each fingerprint once, and its number of occurrences, up to `least`."""
        ordered = np.sort(self.short(prints))  # the order of the bits that come back
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.minimum(np.diff(np.append(heads, len(ordered))), least).astype(np.uint32)
        ordered = ordered[heads]
        ranges = ordered >> np.uint64(8 * CELL)
        firsts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
        bounds = np.append(firsts, len(ordered))
        planes = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
        return pa.record_batch(
            {
                "k": np.full(len(firsts), k, np.int32),
                "range": ranges[firsts].astype(np.int32),
                "block": np.full(len(firsts), block, np.int64),
                "cells": _binary(_cells(ordered), bounds, CELL),
                "counts": _binary(planes, bounds, 4),
            }
        )


def _frequent(block: Block, at: np.ndarray, k: int, ranges: Ranges, told: pa.Table) -> np.ndarray:
    """The frequent short fingerprints, sorted, of those sent for the runs of k words at `at`; a bit tells which."""
    told = told.filter(pa.compute.equal(told.column("k"), k)).sort_by("range")
    if not len(told) or not len(at):
        return np.zeros(0, np.uint64)
    sent = _sorted_set(ranges.short(block.fingerprints(at, k)))
    own = told.column("range").to_numpy().astype(np.uint64)
    bounds = np.searchsorted(sent >> np.uint64(8 * CELL), np.concatenate((own, own + np.uint64(1))))
    first, counts = bounds[: len(own)], bounds[len(own) :] - bounds[: len(own)]
    sizes = pa.compute.binary_length(told.column("bits")).to_numpy().astype(np.int64)
    if not (sizes == -(-counts // 8)).all():
        raise ValueError("a block was told of other fingerprints than it sent")
    bits = np.unpackbits(np.frombuffer(b"".join(b.as_buffer() for b in told.column("bits")), np.uint8)).view(bool)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    often = bits[np.repeat(8 * (np.cumsum(sizes) - sizes), counts) + inside]
    return sent[(np.repeat(first, counts) + inside)[often]]


def _told(block: Block, at: np.ndarray, k: int, ranges: Ranges, frequent: np.ndarray) -> np.ndarray:
    """For each place, whether the run of k words there is among the frequent ones."""
    if not len(frequent) or not len(at):
        return np.zeros(len(at), bool)
    short = ranges.short(block.fingerprints(at, k))
    return frequent[np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)] == short


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {name: batch.column(name)[row].as_py() for name in batch.schema.names}


PACKED = "k int, range int, block long, cells binary, counts binary"
TOLD = "k int, range int, block long, bits binary"


def _with_told(batches: Iterator[pa.RecordBatch]) -> tuple[str, bytes, pa.Table]:
    """Language and data of one block, and the rows of TOLD that it got."""
    rows = pa.Table.from_batches(list(batches))
    is_block = pa.compute.is_valid(rows.column("data"))
    block = rows.filter(is_block)
    return block.column("lang")[0].as_py(), block.column("data")[0].as_py(), rows.filter(pa.compute.invert(is_block)).select(["k", "range", "bits"])


def _long(block: Block, k: int, known: np.ndarray) -> np.ndarray:
    """The runs of k words in which all runs of two words are known."""
    at = block.runs(k)
    for j in range(k - 1):
        at = at[known[at + j]]
    return at


def _pairs(block: Block, longest: int, ranges: Ranges, told: pa.Table) -> np.ndarray:
    """For each word, whether a frequent run of two words starts there."""
    known = np.zeros(len(block.hashes) + max(longest, 2), bool)
    pairs = block.runs(2)
    known[pairs] = _told(block, pairs, 2, ranges, _frequent(block, pairs, 2, ranges, told))
    return known


def _short_runs(ranges: Ranges, least: int):
    """Fingerprints of all words and all runs of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row["lang"], row["data"])
            for k in (1, 2):
                at = block.runs(k)
                if len(at):
                    yield ranges.packed(block.fingerprints(at, k), k, row["block"], least)

    return run


def _long_runs(ranges: Ranges, longest: int, least: int):
    """Fingerprints of the longer runs in which all runs of two words are frequent; for the rows of one block."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, data, told = _with_told(batches)
        if not len(told):
            return
        block = Block(lang, data)
        known = _pairs(block, longest, ranges, told)
        for k in range(3, longest + 1):
            at = _long(block, k, known)
            if len(at):
                yield ranges.packed(block.fingerprints(at, k), k, key[0].as_py(), least)

    return run


def _sum_range(least: int):
    """Which fingerprints of one range are frequent: a bit for each one that a block sent, for the blocks that have any."""

    def run(rows: pa.Table) -> pa.Table:
        cells, sizes = _numbers(rows.column("cells"))
        counts = np.frombuffer(b"".join(c.as_buffer() for c in rows.column("counts").combine_chunks()), "<u4").astype(np.int64)
        order = np.argsort(cells, kind="stable")
        ordered = cells[order]
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        often = np.zeros(len(cells), bool)  # in the order of the rows
        often[order] = np.repeat(np.add.reduceat(counts[order], heads) >= least, np.diff(np.append(heads, len(ordered))))
        first = np.cumsum(sizes) - sizes
        octets = -(-sizes // 8)
        bounds = np.concatenate(([0], np.cumsum(octets)))
        bits = np.zeros(8 * bounds[-1], bool)
        bits[np.arange(len(cells)) + np.repeat(8 * bounds[:-1] - first, sizes)] = often
        out = rows.select(["k", "range", "block"]).append_column("bits", _binary(np.packbits(bits), bounds, 1))
        return out.filter(pa.array(np.logical_or.reduceat(often, first)))

    return run


def _read(ranges: Ranges, longest: int):
    """The frequent phrases of a block and how often it has each; for the rows of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, data, told = _with_told(batches)
        if not len(told):
            return
        block = Block(lang, data)
        number = block.same_words()
        known = _pairs(block, longest, ranges, told)
        for k in range(1, longest + 1):
            at = block.runs(k) if k < 3 else _long(block, k, known)
            at = at[_told(block, at, k, ranges, _frequent(block, at, k, ranges, told))]
            for counts, first in _distinct(block, at, k, number):
                for row in range(0, len(first), PHRASES):
                    heads = first[row : row + PHRASES]
                    starts, ends = block.starts[heads].tolist(), block.ends[heads + k - 1].tolist()
                    phrases = [b" ".join(data[s:e].split()) for s, e in zip(starts, ends, strict=True)]
                    yield pa.record_batch(
                        {
                            "lang": pa.array([lang] * len(heads), pa.string()),
                            "k": np.full(len(heads), k, np.int32),
                            "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                            "n": counts[row : row + PHRASES],
                        }
                    )

    return run


def frequent_phrases(blocks: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f) of all runs of up to `longest` words that occur at least `least` times in their language."""
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    ranges = Ranges(min(max((total // RANGE_WORDS).bit_length(), 4), 64 - 8 * CELL))

    def frequent(sent: DataFrame, name: str) -> DataFrame:
        return written(sent.groupBy("k", "range").applyInArrow(_sum_range(least), TOLD), name)

    def told(own: DataFrame) -> GroupedData:
        return blocks.select("block", "lang", "data").unionByName(own, allowMissingColumns=True).groupBy("block")

    found = frequent(blocks.select("block", "lang", "data").mapInArrow(_short_runs(ranges, least), PACKED), "frequent")
    longer = told(found.filter(F.col("k") == 2)).applyInArrow(_long_runs(ranges, longest, least), PACKED)
    found = found.unionByName(frequent(longer, "longer"))
    read = told(found).applyInArrow(_read(ranges, longest), "lang string, k int, phrase string, n long")
    return written(read.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "phrases")


def wide(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def scored(phrases: DataFrame, scale: int = SCORE) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of the phrases of two words and more, by the cut that scores lowest."""
    words_ = F.split("phrase", " ")
    cuts = phrases.filter(F.col("k") > 1).select("lang", "k", "phrase", F.col("f").alias("a"), words_.alias("w"))
    cuts = cuts.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    left = F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left")
    right = F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("right")
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", left, right)
    # Every part occurs at least as often as the phrase, so it is a frequent phrase too.
    parts = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("s", wide(F.col("a")) * F.lit(scale).cast("decimal(10,0)")).withColumn("t", wide(F.col("l")) + wide(F.col("r")))
    cuts = cuts.withColumn("score", F.expr("s div t"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("m")
    return cuts.groupBy("lang", "k", "phrase", "a").agg(lowest).select("lang", "k", "phrase", "a", "m.l", "m.r", "m.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, outer): for each phrase inside longer frequent ones, the highest number of occurrences of these."""
    longer = phrases.filter(F.col("k") > 2).select("lang", "k", "f", F.split("phrase", " ").alias("w"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")
    return longer.select("lang", inner, "f").groupBy("lang", "phrase").agg(F.max("f").alias("outer"))


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    nested: int = NESTED,
    top: int = TOP,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """The `top` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is `und`. Repeated rows count as often as they occur; doc_id and other columns
    are not read. An empty table, or one without a frequent phrase, gives an empty result.
    """
    blocks = text_blocks(docs, text_column, lang_column)
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    phrases = frequent_phrases(blocks, longest, least)
    found = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left")
    hidden = wide(F.col("outer")) * F.lit(100).cast("decimal(10,0)") >= wide(F.col("a")) * F.lit(nested).cast("decimal(10,0)")
    found = found.filter(~F.coalesce(hidden, F.lit(False))).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language is ranked in parts first; PARTS * top rows of it at most are ranked together.
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH pieces AS (
    SELECT lang, doc, generate_subscripts(list, 1) AS p, unnest(list) AS piece FROM (
        SELECT coalesce(lang, '{UNKNOWN}') AS lang, row_number() OVER () AS doc,
            regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS list
        FROM documents)
), runs AS (
    SELECT lang, doc, p, generate_subscripts(list, 1) AS i, unnest(list) AS w FROM (
        SELECT lang, doc, p, regexp_extract_all(piece, '[^\x20\x09]+') AS list FROM pieces)
), next AS (
    SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM runs WINDOW o AS (PARTITION BY doc, p ORDER BY i)
), grams AS MATERIALIZED (
    SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM next GROUP BY ALL
    UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM next WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM next WHERE w3 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM next WHERE w4 IS NOT NULL GROUP BY ALL
), sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, k, phrase, f, lang || chr(10) || phrase AS name FROM grams WHERE f >= {LEAST}),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM frequent WHERE k > 1),
cuts AS (
    SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, CAST({SCORE}::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
    JOIN frequent l ON l.name = c.lang || chr(10) || array_to_string(list_slice(w, 1, cut), ' ')
    JOIN frequent r ON r.name = c.lang || chr(10) || array_to_string(list_slice(w, cut + 1, c.k), ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
    SELECT lang, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS phrase, max(a) AS outer_ FROM (
        SELECT *, unnest(range(1, k - size + 2)) AS pos FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates)) GROUP BY ALL
), kept AS (
    SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE outer_ IS NULL OR 100::HUGEINT * outer_ < {NESTED}::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang) WHERE rank <= {TOP}
"""
