"""Packing of tokenised documents into sequences of fixed length by the linear grouping scheme.

Lengths are whole numbers up to the length of a sequence, so a histogram says all there is to know about them, and its
size does not depend on the table. On it the plan is made: large lengths are put into groups of equal count and rounded
up to the largest of their group; the best mix of configurations of these few sizes is found by linear programming with
column generation; the actual lengths take the places of the rounded ones; what is left over and the small lengths go
where they fit best. The plan says how many documents of a length go to which sequences; documents of a length are
numbered by Spark and find their place by that number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, with_rank, written
from docpipe.llm.tokens import SpaceEncoder
from docpipe.llm.words import blocks

SEQUENCE = 2048
GROUPS = 64
#: Lengths above a sequence divided by this are large.
LARGE = 16
END = 0
TOLERANCES = (0, 1, 2, 4, 8, 16, 32)


# --- pieces of documents


def pieces(docs: DataFrame, vocabulary: str, capacity: int = SEQUENCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and the end id, cut into pieces from the end.

    All pieces but the first have `capacity` ids. Null and empty texts are one piece of the end id alone.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), body(text_column).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpaceEncoder(vocabulary)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part, _, _ in blocks(batch, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(part.column("text").to_pylist())):
                    ids = memoryview(ids + end)
                    n = len(ids) // 4
                    stop, k = n - (n - 1) // capacity * capacity, 0
                    begin = 0
                    while begin < n:
                        row.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(ids[4 * begin : 4 * stop]))
                        begin, stop, k = stop, stop + capacity, k + 1
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()),
                        "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan, on the histogram of lengths


@dataclass
class Run:
    """`n` sequences with the same lengths in the same order; `used` is their sum."""

    n: int
    lengths: tuple[int, ...]
    used: int


def _groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) of each group: lengths falling, groups of nearly equal count."""
    total = sum(counts.values())
    share = -(-total // groups)
    out: list[list[tuple[int, int]]] = [[]]
    room = share
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return [g for g in out if g]


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value that fits: an unbounded knapsack over all capacities at once."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int32)
    for g, (size, value) in enumerate(zip(sizes, values, strict=True)):
        if value <= 1e-12:
            continue
        for _ in range(capacity // size):
            with_one = best[:-size] + value
            better = with_one > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = with_one[better]
            took[size:][better] = g
    # Values only grew after a choice was noted, so walking back may meet a better rest than was counted; never a worse.
    pattern = np.zeros(len(sizes), np.int64)
    room = int(best.argmax())
    while took[room] >= 0:
        pattern[took[room]] += 1
        room -= int(sizes[took[room]])
    return float(pattern @ values), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, so that demand is met by the fewest sequences (in fractions)."""
    s, d = np.array(sizes, np.int64), np.array(demand, float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(rounds):
        values = np.linalg.solve(basis.T, np.ones(len(s)))
        value, pattern = _best_pattern(s, values, capacity)
        if value <= 1 + 1e-7:
            break
        amounts = np.linalg.solve(basis, d)
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    amounts = np.linalg.solve(basis, d)
    return [(basis[:, j].astype(np.int64), float(x)) for j, x in enumerate(amounts) if x > 1e-9]


class _Fit:
    """Runs by the room they have left."""

    def __init__(self, runs: list[Run], capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[Run]] = {}
        self.rooms: list[int] = []
        for run in runs:
            self.put(run)

    def put(self, run: Run) -> None:
        room = self.capacity - run.used
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append(run)

    def add(self, length: int, count: int) -> None:
        """Place `count` documents of a length, each where the least room is left after it."""
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = min(self.capacity // length, count)
                n = count // each
                self.put(Run(n, (length,) * each, length * each))
                count -= n * each
                continue
            room = self.rooms[i]
            run = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(i)
            n = min(run.n, count)
            if n < run.n:
                self.put(Run(run.n - n, run.lengths, run.used))
            # As many of this length as still fit go in at once while there are enough for all sequences of the run.
            each = max(1, min((self.capacity - run.used) // length, count // n))
            self.put(Run(n, run.lengths + (length,) * each, run.used + each * length))
            count -= n * each

    def runs(self) -> list[Run]:
        return [r for room in self.rooms for r in self.by_room[room]]


def plan(counts: dict[int, int], capacity: int = SEQUENCE, groups: int = GROUPS) -> list[Run]:
    """Sequences for counts[length] documents of each length (1 to capacity)."""
    runs = [Run(counts[capacity], (capacity,), capacity)] if counts.get(capacity) else []
    large = {x: n for x, n in counts.items() if capacity // LARGE < x < capacity and n}
    left: dict[int, int] = {x: n for x, n in counts.items() if x <= capacity // LARGE and n}
    if large:
        grouped = _groups(large, groups)
        stock = [list(reversed(g)) for g in grouped]  # pop() takes the largest first

        def take(g: int, n: int) -> list[tuple[int, int]]:
            out = []
            while n:
                length, have = stock[g].pop()
                out.append((length, min(n, have)))
                if have > n:
                    stock[g].append((length, have - n))
                n -= out[-1][1]
            return out

        found = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity)
        for pattern, amount in found:
            n = int(amount + 1e-6)
            have = [sum(c for _, c in s) for s in stock]
            n = min([n, *(have[g] // int(k) for g, k in enumerate(pattern) if k)])
            if not n:
                continue
            places = [take(g, n) for g, k in enumerate(pattern) for _ in range(int(k))]
            while places and places[0]:
                step = min(p[0][1] for p in places)
                lengths = tuple(p[0][0] for p in places)
                runs.append(Run(step, lengths, sum(lengths)))
                places = [([(p[0][0], p[0][1] - step)] if p[0][1] > step else []) + p[1:] for p in places]
        for s in stock:
            for length, n in s:
                left[length] = left.get(length, 0) + n
    fit = _Fit(runs, capacity)
    for length in sorted(left, reverse=True):
        fit.add(length, left[length])
    return _repacked(fit.runs(), capacity)


def _repacked(runs: list[Run], capacity: int) -> list[Run]:
    """Where rounding up left room that no small length fills, open the sequences with more room than a tolerance and
    fit their lengths anew, largest first; the tolerance that needs the fewest sequences is taken."""
    best = runs
    for tolerance in TOLERANCES:
        full = [r for r in runs if capacity - r.used <= tolerance]
        counts: dict[int, int] = {}
        for r in runs:
            if capacity - r.used > tolerance:
                for length in r.lengths:
                    counts[length] = counts.get(length, 0) + r.n
        fit = _Fit([], capacity)
        for length in sorted(counts, reverse=True):
            fit.add(length, counts[length])
        again = full + fit.runs()
        if sum(r.n for r in again) < sum(r.n for r in best):
            best = again
    return best


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """Where documents of a length go by their number: from number `rank` of `length` on, to `sequence` on, at `offset`."""
    used: dict[int, int] = {}
    rows = []
    first = 0
    for run in runs:
        offset = 0
        for length in run.lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, first, offset))
            used[length] = rank + run.n
            offset += length
        first += run.n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": cols[0] << 44 | cols[1], "rank": cols[1], "sequence": cols[2], "offset": cols[3]}


# --- the plan, applied


def pack(found: DataFrame, capacity: int = SEQUENCE, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, ..., length) with lengths from 1 to capacity.

    Repeated rows are packed like others. An empty table gives an empty result.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    at = spark.sparkContext.broadcast(places(plan(counts, capacity, groups)))
    ranked = with_rank(found, "length", ["doc_id", "piece"], "_rank", sum(counts.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = at.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            i = np.searchsorted(where["key"], batch.column("length").to_numpy() << 44 | rank, side="right") - 1
            kept = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
            yield pa.record_batch(kept | {"sequence_id": where["sequence"][i] + rank - where["rank"][i], "offset": where["offset"][i]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text, ...) with their place: see pieces() and pack()."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return pack(written(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
