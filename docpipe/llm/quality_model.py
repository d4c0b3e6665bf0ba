"""A quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of whole texts are computed where the texts are read. The trees are grown on a sample of labelled documents
of bounded size (SAMPLE rows, a parameter) and flattened to arrays, with which numpy scores all documents of a batch at
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, text_hash
from docpipe.llm.words import blocks, grams, repeated, sums, words

#: Labelled rows the trees are grown on: those with the smallest hash of doc_id.
SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 64
TREES, DEPTH, RATE, RIDGE, LEAST = 60, 4, 0.15, 1.0, 5.0


# --- statistics


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_CLASSES = {
    "symbols": _mask(b"#*$%&|<>~^_={}[]\\/@+"),
    "capitals": _mask(bytes(range(65, 91))),
    "digits": _mask(bytes(range(48, 58))),
    "stops": _mask(b".,;:"),
    "cries": _mask(b"!?"),
    "bars": _mask(b"|"),
    "wide": _mask(bytes(range(128, 256))),
    "spaces": _mask(b" \t\r\x0b\x0c"),
}
FEATURES = (
    *_CLASSES, "bytes", "words", "word_length", "word_spread", "short_words", "distinct", "repeated_2", "repeated_8", "lines", "line_length", "repeated_lines", "same_lengths",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text. Shares of nothing are 0."""
    found = words(data, offsets)
    owner = found.text_of()
    size = np.diff(offsets).astype(float)
    count = found.counts.astype(float)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)

    length = (found.ends - found.starts).astype(np.int64)
    mean = share(sums(length, found.bounds), count)
    spread = np.sqrt(np.maximum(share(sums(length * length, found.bounds), count) - mean * mean, 0))
    cols = [share(sums(mask[data], offsets), size) for mask in _CLASSES.values()]
    cols += [np.log1p(size), np.log1p(count), mean, spread, share(sums(length <= 2, found.bounds), count)]
    cols.append(1 - share(sums(repeated(found.hashes, owner), found.bounds), count))
    for k in (2, 8):
        gram, at = grams(found, k)
        again = np.zeros(len(owner), bool)
        again[at] = repeated(gram, owner[at])
        cols.append(share(sums(again, found.bounds), count))
    breaks = np.flatnonzero(data == 10)
    lines = sums(data == 10, offsets) + 1.0
    cols += [np.log1p(lines), np.log1p(share(count, lines))]
    # Lines are the stretches between breaks and text ends; lines with the same words count as equal here.
    edges = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    edges = edges[edges < len(data)]
    first = np.searchsorted(found.starts, np.concatenate((edges, [len(data)])))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(found.hashes)))
    line = total[first[1:]] - total[first[:-1]]
    of = np.searchsorted(offsets, edges, side="right") - 1
    full = first[1:] > first[:-1]
    again = repeated(line[full], of[full])
    bounds = np.searchsorted(of[full], np.arange(len(size) + 1))
    cols.append(share(sums(again, bounds), np.diff(bounds).astype(float)))
    same = np.zeros(len(owner), bool)
    same[1:] = (length[1:] == length[:-1]) & (owner[1:] == owner[:-1])
    cols.append(share(sums(same, found.bounds), count))
    return np.column_stack(cols)


# --- trees


@dataclass(frozen=True)
class Trees:
    """Complete trees of equal depth as arrays [tree, node]: inner nodes in breadth-first order, then the leaves."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1 if self.feature.size else 0
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost trees for the log loss with Newton steps; splits are taken from histograms of BINS bins per feature.

    Without rows every score is 0.5; with one label only, scores stay near that label.
    """
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    inner = 2**depth - 1
    rate = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(rate / (1 - rate)))
    feature, limit, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not n:
        return Trees(feature, limit, leaf, start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin b: x <= edges[b]
    flat = binned + np.arange(width) * BINS
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            shape = (many, width, BINS)
            g = np.bincount(at, np.repeat(slope, width), many * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(bend, width), many * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < LEAST) | (all_h - h < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, first + k], limit[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        g = np.bincount(node - inner, slope, inner + 1)
        h = np.bincount(node - inner, bend, inner + 1)
        leaf[t] = RATE * g / (h + RIDGE)
        margin += leaf[t][node - inner]
    return Trees(feature, limit, leaf, start)


# --- tables


def held_out(column: str = "doc_id") -> Column:
    """Rows kept from learning: the remainder of crc32(doc_id as text) by FOLDS is 0. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            x = statistics(data, offsets)
            yield pa.record_batch({"label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Grow trees on up to `sample` labelled documents that are not held out. Rows without label are left aside.

    Each pair of a doc_id and a label is one row, however often it or the document is repeated; where one doc_id has
    several texts, one of them is taken (by its hash). So no more than `sample` rows reach the driver.
    """
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(text_hash(), "text")).alias("one")).select("label", "one.text")
    found = rows.mapInArrow(_features, "label double, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, found.column("label").to_numpy()))  # the same trees whatever the order of the partitions
    return grow(x[order], found.column("label").to_numpy()[order])


def score_documents(docs: DataFrame, trees: Trees, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of each row. Null texts count as empty; repeated rows get the same score."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(F.col(id_column).alias("doc_id"), body(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": model.value.score(statistics(data, offsets))})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
