"""Words of Arrow batches as arrays: hashes, bounds and lengths for all texts of a block at once.

A word is a run of bytes outside ASCII white space (20, 09-0D); its hash is 64 bits wide. Blocks are bounded in bytes,
so that memory does not depend on the number of rows in an Arrow batch; a longer text is a block by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 - 2  # 3 modulo 8, so that powers of it differ in their low bits
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made as long as a block needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BLOCK_BYTES)
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up[:n], self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    if lower:
        values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


@dataclass
class Words:
    """Words of the texts of a block: text d has the words bounds[d] to bounds[d + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # byte in the block
    ends: np.ndarray
    data: np.ndarray  # bytes of the block
    offsets: np.ndarray  # text d has the bytes offsets[d] to offsets[d + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if len(starts):
        up, down = _POWERS.upto(n)
        hashes = mix(np.add.reduceat(_VALUES[lower][data] * up, starts) * down[starts])
        ends = starts + np.add.reduceat(inside, starts, dtype=np.int64)
    else:
        hashes, ends = np.zeros(0, np.uint64), starts
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and the number of the first word of each."""
    h = found.hashes
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j : len(h) - k + 1 + j]
    last = np.repeat(found.bounds[1:], found.counts)[: len(out)]
    at = np.flatnonzero(np.arange(len(out)) + k <= last)
    return mix(out[at]), at


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return values, at - at[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with up to `limit` bytes of text (or one row), the bytes, and the offsets of their rows."""
    if not batch.num_rows:
        return
    data, offsets = text_bytes(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[d], offsets[d + 1]), as long."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each element, whether its owner has the same value at another place too."""
    if not len(values):
        return np.zeros(0, bool)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(v), bool)
    out[order] = twice
    return out
