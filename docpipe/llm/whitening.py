"""Whitening of embeddings by their exact covariance, found from variances alone.

Vectors become integers, so that all sums are exact. With n vectors x of sum S, the squares of n * x - S are summed for
every dimension and for the sum of every pair of dimensions. As Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), differences
of these sums give every cross-covariance; the matrix (dimensions squared, whatever the number of rows) goes to eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import table, written

SCALE = 256
COMPONENTS = 4
#: An eigenvalue below this part of the largest one is rounding: the vectors do not vary along it.
RANK_TOLERANCE = 1e-12
#: Vectors that are squared at once.
ROWS = 4096
#: Exact sums travel as this many digits of 40 bits, the first one signed, so that their sums over tasks fit 64 bits.
DIGITS, BITS = 6, 40
DIGIT_NAMES = [f"d{k}" for k in range(DIGITS)]
LOW = (1 << 24) - 1


def digits(value: int) -> list[int]:
    return [(value >> (BITS * k)) & ((1 << BITS) - 1) for k in range(DIGITS - 1)] + [value >> (BITS * (DIGITS - 1))]


def number(row) -> int:
    return sum(int(row[d]) << (BITS * k) for k, d in enumerate(DIGIT_NAMES))


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * c) of each entry as long, without vectors that are null or hold null, NaN or infinity.

    An entry beyond a long becomes the nearest long. Of vectors of different lengths only those of the most frequent
    length stay (ties: the longer); empty vectors go.
    """
    entry = F.col(vector_column).cast("array<double>")
    odd = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(entry.isNotNull() & ~odd & (F.size(entry) > 0))
    rows = rows.select(F.col(id_column).alias("vec_id"), F.transform(entry, lambda c: F.floor(c * scale)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).limit(1)
    length = (lengths.first() or [0])[0]
    return rows.filter(F.size("x") == length)


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exact: 64 bits where all sums of two entries fit, integers of any size otherwise."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(t)) for t in total)
    if 2 * most < 1 << 62:
        return x * np.int64(n) - total.astype(np.int64)
    return x.astype(object) * n - total


def _square_sums(z: np.ndarray) -> list[int]:
    """Exact sums of the squares of each column of up to ROWS rows."""
    if z.dtype == object or (len(z) and int(np.abs(z).max()) >= 1 << 48):
        return [int(s) for s in (z.astype(object) ** 2).sum(axis=0)]
    high, low = z >> 24, z & LOW  # both below 2**24 in size: sums of their products over ROWS rows fit 64 bits
    parts = [(a * b).sum(axis=0).tolist() for a, b in ((high, high), (high, low), (low, low))]
    return [(hh << 48) + (hl << 25) + ll for hh, hl, ll in zip(*parts, strict=True)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            small = np.abs(x.astype(np.float64)).max() * len(x) < 1 << 62
            part = (x if small else x.astype(object)).sum(axis=0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        rows = [digits(int(t)) for t in total]
        yield pa.record_batch({"i": np.arange(len(rows), dtype=np.int32)} | {d: np.array(c, np.int64) for d, c in zip(DIGIT_NAMES, zip(*rows, strict=True), strict=True)})


def _pair_sums(n: int, total: np.ndarray):
    """For the task's vectors: sums of squares of y[i] (as i, i) and of y[i] + y[j]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(total)
        found: list[list[int]] = [[0] * (d - i) for i in range(d)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _centred(_matrix(batch.slice(at, ROWS)), n, total)
                for i in range(d):
                    z = y[:, i:] + y[:, i : i + 1]
                    z[:, 0] = y[:, i]
                    found[i] = [a + b for a, b in zip(found[i], _square_sums(z), strict=True)]
        rows = [(i, i + k, *digits(v)) for i in range(d) for k, v in enumerate(found[i])]
        columns = list(zip(*rows, strict=True))
        yield pa.record_batch(
            {"i": np.array(columns[0], np.int32), "j": np.array(columns[1], np.int32)}
            | {name: np.array(c, np.int64) for name, c in zip(DIGIT_NAMES, columns[2:], strict=True)}
        )

    return run


_DIGIT_SCHEMA = ", ".join(f"{d} long" for d in DIGIT_NAMES)


def _totals(parts: DataFrame, keys: list[str]) -> list:
    """As many rows as there are keys, which depends on the dimensions only."""
    return parts.groupBy(*keys).agg(*[F.sum(d).alias(d) for d in DIGIT_NAMES]).orderBy(*keys).collect()


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list; components (a column each) and their eigenvalues by falling size; the trace."""

    n: int
    total: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN along components without variance."""
        y = _centred(x, self.n, self.total).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, (y @ self.components) / np.sqrt(self.eigenvalues), np.nan)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the distinct vectors of fit (x); None if there are none."""
    n = fit.count()
    if not n:
        return None
    total = np.array([number(r) for r in _totals(fit.select("x").mapInArrow(_sums, f"i int, {_DIGIT_SCHEMA}"), ["i"])], object)
    pairs = fit.select("x").mapInArrow(_pair_sums(n, total), f"i int, j int, {_DIGIT_SCHEMA}")
    d = len(total)
    squares = {(r["i"], r["j"]): number(r) for r in _totals(pairs, ["i", "j"])}
    covariance = np.empty((d, d))
    scale = 2 * n**3
    for (i, j), s in squares.items():
        twice = 2 * s if i == j else s - squares[i, i] - squares[j, j]
        covariance[i, j] = covariance[j, i] = float(Fraction(twice, scale))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    top = np.where(values[order] > RANK_TOLERANCE * max(values.max(), 0.0), values[order], 0.0)
    chosen = vectors[:, order]
    # Either sign is right; take that which makes the largest entry positive.
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Whitening(n, total, chosen, top, float(Fraction(sum(squares[i, i] for i in range(d)), n**3)))


def _moments(whitening: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitening.eigenvalues)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = whitening.project(_matrix(batch))
                first += w.sum(axis=0)
                second += w.T @ w
        rows = [(a, b, float(first[a]), float(second[a, b])) for a in range(k) for b in range(k)]
        yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["a", "b", "first", "second"])

    return run


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components with variance."""
    parts = fit.select("x").mapInArrow(_moments(whitening), "a long, b long, first double, second double")
    rows = parts.groupBy("a", "b").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect()
    means = {r["a"]: r["first"] / whitening.n for r in rows}
    good = [r for r in rows if whitening.eigenvalues[r["a"]] > 0 and whitening.eigenvalues[r["b"]] > 0]
    return max((abs(r["second"] / whitening.n - means[r["a"]] * means[r["b"]] - (r["a"] == r["b"])) for r in good), default=0.0)


def _whitened(whitening: Whitening, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(whitening.eigenvalues)
        explained = whitening.eigenvalues / whitening.trace if whitening.trace > 0 else np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            y = _centred(x, whitening.n, whitening.total)
            fits = y.dtype != object and x.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63
            deviation = (y * y).sum(axis=1).tolist() if fits else [int(s) for s in (y.astype(object) ** 2).sum(axis=1)]
            rows = len(x)
            w = whitening.project(x).ravel()
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    "n": np.full(rows * k, whitening.n, np.int64),
                    "deviation": pa.array([v if v < 1 << 63 else None for v in deviation for _ in range(k)], pa.int64()),
                    "whitened": pa.array(w, mask=np.isnan(w)),
                    "explained": np.tile(explained, rows),
                    "identity_error": np.full(rows * k, error),
                }
            )

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null, NaN or infinity are left out, see integer_vectors() for lengths. Repeated rows
    and rows with a null id each get their rows; equal vectors count once in the fit. deviation is null where it passes
    64 bits. Along a component without variance whitened is null and explained 0. An empty table gives an empty result;
    vectors of fewer dimensions than components give a row per dimension. Other columns are ignored.
    """
    rows = written(integer_vectors(vectors, id_column, vector_column, scale), "vectors")
    fit = written(rows.select("x").distinct(), "fit")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whitening = fit_whitening(fit, components)
    if whitening is None:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_whitened(whitening, identity_error(fit, whitening)), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
