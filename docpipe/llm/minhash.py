"""Near duplicates by min-max hashing: of each permutation both the smallest and the largest value are kept.

A permutation is evaluated once for two signature values, so signatures cost half as many hashes. Values of one
permutation never share a band. Steps:

1. every text becomes a set of word shingles, its digest and its signature; equal sets are one class from here on,
   whatever their number,
2. classes that agree in a band meet at one of the band's classes (a pivot, first the one that shares most bands), not
   in pairs; another round uses other pivots for those that are still apart. At last whoever is left meets those of
   other components with which it shares one of its rarest shingles, so early in both that the rest can suffice
   (prefix and position filter, which lose no similar pair),
3. a pair goes on if its signatures agree as far as those of similar sets do (six standard deviations below the
   threshold is enough), and is a link if the full sets confirm it,
4. links are contracted to components round by round with min-label steps; links inside a component are not looked for.

All tables grow with the number of documents; nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, text_hash, written
from docpipe.llm.words import blocks, grams, mix, words

SHINGLE = 5
PERCENT = 80
#: 32 bands of 5 values: sets with similarity 0.8 share no band with probability 3e-6.
BANDS, BAND = 32, 5
PERMUTATIONS = BANDS * BAND // 2
#: Values (of 160) on which two signatures must agree: similar sets agree on 128 on average, with a deviation of 5.
AGREE = 96
#: Rounds with one pivot per band, before those left are compared by their rarest shingles.
PIVOT_ROUNDS = 2


@dataclass(frozen=True)
class _Permutations:
    """x -> a * x + b modulo 2**32, with a odd: bijections of 32-bit values."""

    a: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, n: int) -> _Permutations:
        seed = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return cls((seed >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seed.astype(np.uint32))


_PERMUTATIONS = _Permutations.of(PERMUTATIONS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds.

    A text with fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    found = words(data, offsets, lower=True)
    texts = len(offsets) - 1
    gram, at = grams(found, size)
    owner = found.text_of()[at] if len(at) else at
    counts = found.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            for h in found.hashes[found.bounds[d] : found.bounds[d + 1]]:
                whole[i : i + 1] = mix(whole[i : i + 1] * np.uint64(31) + h + np.uint64(1))
        gram, owner = np.concatenate([gram, whole]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    gram, owner = gram[keep], owner[keep]
    return gram, np.searchsorted(owner, np.arange(texts + 1))


def signatures(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then their maxima, for each set that is not empty (others: zeros)."""
    out = np.zeros((len(bounds) - 1, 2 * PERMUTATIONS), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (gram >> np.uint64(32)).astype(np.uint32)
        starts = bounds[:-1][full]
        for p in range(PERMUTATIONS):
            y = x * _PERMUTATIONS.a[p] + _PERMUTATIONS.b[p]
            out[full, p] = np.minimum.reduceat(y, starts)
            out[full, PERMUTATIONS + p] = np.maximum.reduceat(y, starts)
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit value per band, the number of the band included."""
    values = np.zeros((len(signature), BANDS), np.uint64)
    parts = signature.reshape(len(signature), BANDS, BAND).astype(np.uint64)
    for j in range(BAND):
        values = mix(values * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j] + np.uint64(j + 1))
    return mix(values + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC4CEB9FE1A85EC53))


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", 1 << 20):
                gram, bounds = shingle_sets(data, offsets, size)
                signature = signatures(gram, bounds)
                raw = gram.tobytes()
                counts = np.diff(bounds)
                bands = _bands(signature).astype(np.int64).ravel()
                low = (signature & np.uint32(0xFF)).astype(np.uint8)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_hash": part.column("text_hash"),
                        "n_shingles": counts.astype(np.int64),
                        "digest": pa.array(
                            [blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                            pa.binary(),
                        ),
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * BANDS, pa.int32()), pa.array(bands)),
                        "low": pa.array([r.tobytes() for r in low], pa.binary()),
                    }
                )

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, low_a, low_b) whose signatures agree on enough values (by their low bytes)."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("low_a", "low_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _confirm(size: int, percent: int):
    """Keep the pairs (a, b, text_a, text_b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("text_a", "text_b"):
                own = []
                for _, data, offsets in blocks(batch, side):
                    gram, bounds = shingle_sets(data, offsets, size)
                    own += [gram[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                sides.append(own)
            similar = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(similar))

    return run


def _shingle_rows(size: int):
    """(node, gram) for each distinct shingle of the texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                gram, bounds = shingle_sets(data, offsets, size)
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                yield pa.record_batch({"node": part.column("node").take(pa.array(owner)), "gram": gram.astype(np.int64)})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of links (a, b) that are not roots themselves.

    Large-star and small-star steps in turn: neighbours of a node move to the least of them, until all are stars.
    Minima are combined before they are shuffled, and the joins are split where a node has very many neighbours.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.distinct(), "edges")
        state = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots_with_root = edges.join(state.select(F.col("u").alias("v")), "v", "left_semi")
        if state.filter("n > 1").isEmpty() and roots_with_root.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links (a, b) between nodes."""
    side = labels.select(F.col("node").alias("x"), F.col("label").alias("lx"))
    lifted = links.join(side, F.col("a") == F.col("x")).select(F.col("lx").alias("p"), "b")
    lifted = lifted.join(side, F.col("b") == F.col("x")).select(F.col("p").alias("a"), F.col("lx").alias("b"))
    root = components(lifted).select(F.col("node").alias("label"), "root")
    return written(labels.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")


def describe(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, bands, low) of each row; text_hash tells rows with one doc_id apart."""
    rows = _rows(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_describe(size), f"doc_id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>, low binary")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), text_hash(text_column).alias("text_hash"), body(text_column).alias("text"))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links (similarity of the sets of `size` words >= percent).

    * Texts without words (null, empty, blank) have the empty set and are linked with nothing.
    * Repeated rows (same doc_id and text) get the same answer; equal texts are linked however many there are.
    * A null doc_id counts as no number: the component has the smallest number there is, or null if there is none.
    * An empty table gives an empty result.
    """
    described = written(describe(docs, size, id_column, text_column), "described")
    classes = described.filter("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands"), F.any_value("low").alias("low"), F.any_value("n_shingles").alias("size")
    )
    classes = written(classes.withColumnRenamed("digest", "node"), "classes")
    exploded = classes.select("node", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = written(exploded.join(shared, "band"), "members")

    nodes = members.select("node").distinct()
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    wanted = nodes.join(classes, "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("text_hash"))
    rows = _rows(docs, id_column, text_column)
    texts = rows.join(wanted, (rows["doc_id"].eqNullSafe(wanted["_id"])) & (rows["text_hash"] == wanted["text_hash"]))
    # Rows that repeat (doc_id, text) give their class one text, and its shingles once.
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    low = classes.select("node", "low")

    def links(pairs: DataFrame) -> DataFrame:
        close = pairs.join(low.select(F.col("node").alias("a"), F.col("low").alias("low_a")), "a")
        close = close.join(low.select(F.col("node").alias("b"), F.col("low").alias("low_b")), "b")
        close = written(close.mapInArrow(_agree, "a binary, b binary"), "close")
        full = close.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        full = full.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return written(full.mapInArrow(_confirm(size, percent), "a binary, b binary"), "links")

    def apart(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Members (band, node, label) of the bands in which more than one component meets."""
        known = members.drop("label").join(labels, "node")
        several = known.groupBy("band").agg((F.min("label") != F.max("label")).alias("several")).filter("several").select("band")
        return written(known.join(several, "band"), "members")

    def rarest(members: DataFrame) -> DataFrame:
        """(gram, node, label, size, place): the rarest shingles of each class, as many as a partner must share one of.

        Shingles are put in order of their number of classes; those of one class only take places but need no row.
        """
        open_nodes = members.select("node", "label").distinct().join(classes.select("node", "size"), "node")
        grams_of = written(open_nodes.join(texts, "node").select("node", "text").mapInArrow(_shingle_rows(size), "node binary, gram long"), "grams")
        common = grams_of.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        order = Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "gram")
        placed = grams_of.join(common, "gram", "left").withColumn("place", F.row_number().over(order) - 1).filter("n > 1")
        placed = placed.select("node", "gram", "place").join(open_nodes, "node")
        return written(placed.filter(f"100 * (size - place) >= {percent} * size"), "rarest")

    # The class with most shared bands is the middle of its group: the others are links of it sooner than of each other.
    shared_bands = members.groupBy("node").agg(F.count(F.lit(1)).alias("shared_bands"))
    open_members = written(members.join(shared_bands, "node").withColumn("label", F.col("node")), "members")
    tested = None
    for turn in range(PIVOT_ROUNDS + 1):
        if turn < PIVOT_ROUNDS:
            rank = F.xxhash64("node", F.lit(turn), "band") if turn else -F.col("shared_bands")
            pivots = open_members.groupBy("band").agg(F.min(F.struct(rank.alias("rank"), "node", "label")).alias("pivot"))
            # Both sides are plain shuffles, so that a band with very many classes is split at run time.
            met = open_members.join(written(pivots, "pivots"), "band").filter("label != pivot.label").select(F.col("pivot.node").alias("x"), F.col("node").alias("y"))
        else:
            # The first shingle that two sets share, in the order of all, has few before it in both, if they are similar.
            first = rarest(open_members)
            other = first.select("gram", F.col("node").alias("y"), F.col("label").alias("other"), F.col("size").alias("size_y"), F.col("place").alias("place_y"))
            enough = f"{100 + percent} * least(size - place, size_y - place_y) >= {percent} * (size + size_y)"
            met = first.join(other, "gram").filter(f"label < other AND {enough}").select(F.col("node").alias("x"), "y")
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        labels = _relabel(labels, links(pairs))
        if turn < PIVOT_ROUNDS:
            tested = pairs if tested is None else tested.unionByName(pairs)
            open_members = apart(open_members, labels)
            if open_members.isEmpty():
                break

    # The smallest doc_id of each component, nulls aside; classes without a shared band are components by themselves.
    labelled = classes.select("node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = written(labelled.join(smallest, "label").select(F.col("node").alias("digest"), "component_id"), "of_class")
    found = described.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    found = found.join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
