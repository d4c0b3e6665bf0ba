"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes at minimisers are kept: places chosen by the words around them, so that equal passages choose equal places.

1. Equal texts become one text from here on, whatever their number; each is reduced to its minimisers and a hash of the
   words that any long enough match shares to the right of its first minimiser.
2. Hashes that stand in more than one text name the suffixes that can match at all. Each carries the words that decide
   on a match: LENGTH to the right and WINDOW - 1 to the left. Equal suffixes become one, with the texts they stand in.
3. The suffixes are sorted by the words to the right, across the cluster by ranges, so that a frequent passage is spread
   over tasks. Neighbours of different texts are extended to both sides. A second time they are sorted by the words to
   the left. The first order tells the most words any other text shares to the right, the second the most to the left.
4. Where the neighbours reach both of these, nothing more can be found. Where they do not (many texts share the words on
   one side of a minimiser, and the partner on both sides is nearest in neither order), every run of LENGTH words that
   the two bounds allow is hashed and counted, among the suffixes with the same words to the right.
5. Matches are united per text and handed to all documents that have it.

A run of LENGTH words has its first smallest gram within its first WINDOW words, so all its words lie within what the
suffix there carries. Runs around one place overlap: the first and the last of them tell the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, written
from docpipe.llm.words import Words, blocks, grams, mix, text_bytes, words

LENGTH = 50
GRAM = 8
WINDOW = 24


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(found: Words, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Numbers of the words at which the smallest hash of `gram` words in some run of `window` such hashes begins.

    Runs across the border of two texts may add a place, which does no harm; ties are all kept.
    """
    hashes, at = grams(found, gram)
    if not len(hashes):
        return at
    width = min(window, len(hashes))
    least = _sliding(hashes, width, np.minimum)
    # A value is chosen if the largest of the minima of all runs it belongs to is itself.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    return at[_sliding(padded, width, np.maximum) == hashes]


def _reach(length: int, window: int) -> int:
    """Words to the right of its first minimiser that every long enough match has."""
    return length - window + 1


def _describe(length: int, gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                found = words(data, offsets)
                raw = data.tobytes()
                hashes, at = grams(found, _reach(length, window))
                chosen = np.intersect1d(minimisers(found, gram, window), at, assume_unique=True)
                key = hashes[np.searchsorted(at, chosen)].astype(np.int64)
                text = np.searchsorted(found.bounds, chosen, side="right") - 1
                bounds = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "text_key": pa.array([md5(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                        "n_words": found.counts.astype(np.int64),
                        "keys": pa.ListArray.from_arrays(pa.array(bounds), pa.array(key)),
                        "places": pa.ListArray.from_arrays(pa.array(bounds), pa.array((chosen - found.bounds[text]).astype(np.int32))),
                    }
                )

    return run


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of 64-bit values as bytes that sort like the rows."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * np.int32(8 * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(">u8").tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return text_bytes(column)[0].view(np.uint64).reshape(len(column), width)


def _suffixes(length: int, window: int, rows: int = 20_000):
    """The suffixes at the wanted places: their words to the right, and those to the left in reverse; 0 is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                found = words(data, offsets)
                code = np.append(np.maximum(found.hashes, np.uint64(1)), np.uint64(0))
                none = len(code) - 1
                hashes, at = grams(found, _reach(length, window))
                places = part.column("places")
                owner = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False))
                place = places.flatten().to_numpy()
                number = part.column("number").to_numpy()[owner]
                for i in range(0, len(place), rows):
                    text = owner[i : i + rows, None]
                    p = found.bounds[text] + place[i : i + rows, None]
                    right, left = p + np.arange(length), p - 1 - np.arange(window - 1)
                    yield pa.record_batch(
                        {
                            "key": hashes[np.searchsorted(at, p[:, 0])].astype(np.int64),
                            "right": _binary(code[np.where(right < found.bounds[text + 1], right, none)]),
                            "left": _binary(code[np.where(left >= found.bounds[text], left, none)]),
                            "number": number[i : i + rows],
                            "place": place[i : i + rows],
                        }
                    )

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the rows of a and b share from their start; what lies beyond a text is shared with nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


_NODE = "key long, node binary, right binary, left binary, low long, high long, most_right int, most_left int, first int, last int"


def _extend(length: int, window: int, order: str):
    """Compares suffixes, which come in order, with the nearest before and behind them that are of another text.

    `first` and `last` become the least and the largest number of words left of the place with which a run of `length`
    words repeats, most_<order> the most words any other text shares on that side. At the ends of a task, where a
    neighbour is not seen, that is all words there are.
    """

    def judge(rows: pa.RecordBatch, skip: int, stop: int) -> pa.RecordBatch:
        n = rows.num_rows
        key, low, high = (rows.column(c).to_numpy() for c in ("key", "low", "high"))
        right, left = _matrix(rows.column("right"), length), _matrix(rows.column("left"), window - 1)
        most, first, last = (rows.column(c).to_numpy().copy() for c in (f"most_{order}", "first", "last"))
        heads = _heads(key, low, high)
        run = np.cumsum(heads) - 1
        starts = np.append(np.flatnonzero(heads), n)
        own_right, own_left = (right != 0).sum(axis=1), (left != 0).sum(axis=1)
        side = own_right if order == "right" else own_left
        several = low != high
        unseen = np.zeros(n, bool)

        def meet(i: np.ndarray, r: np.ndarray, l: np.ndarray) -> None:
            most[i] = np.maximum(most[i], r if order == "right" else l)
            a, b = np.maximum(0, length - r), np.minimum(l, window - 1)
            i, a, b = i[a <= b], a[a <= b], b[a <= b]
            first[i], last[i] = np.minimum(first[i], a), np.maximum(last[i], b)

        meet(np.flatnonzero(several), own_right[several], own_left[several])
        for other in (starts[run] - 1, starts[run + 1]):
            outside = (other < 0) | (other == n)
            unseen |= outside
            i = np.flatnonzero(~outside)
            i = i[key[i] == key[other[i]]]
            j = other[i]
            meet(i, _shared(right[i], right[j]), _shared(left[i], left[j]))
        most[unseen] = side[unseen]
        changed = {f"most_{order}": most, "first": first, "last": last}
        return pa.record_batch({c: pa.array(changed[c]) if c in changed else rows.column(c) for c in rows.schema.names}).slice(skip, stop - skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skip = None, 0  # the suffixes of the last text, after the one before them
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            begin = int(np.flatnonzero(_heads(*(rows.column(c).to_numpy() for c in ("key", "low", "high"))))[-1])
            if begin > skip:
                yield judge(rows, skip, begin)
            held, skip = (rows.slice(begin - 1), 1) if begin else (rows, 0)
        if held is not None:
            yield judge(held, skip, held.num_rows)

    return run


def _heads(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where another hash or another text begins; a suffix that several texts have stands alone."""
    heads = np.ones(len(key), bool)
    heads[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (low[1:] != high[1:])
    return heads


def _runs(length: int, window: int):
    """(key, words_left, hash, node, low, high) of each run of `length` words that the bounds of a suffix allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            around = np.hstack((_matrix(batch.column("left"), window - 1)[:, ::-1], _matrix(batch.column("right"), length)))
            least = np.maximum(0, length - batch.column("most_right").to_numpy())
            most = np.minimum(window - 1, batch.column("most_left").to_numpy())
            for l in range(window):
                i = np.flatnonzero((least <= l) & (l <= most))
                if len(i):
                    start = window - 1 - l
                    flat = _row_hash(around[i, start : start + length])
                    taken = batch.take(pa.array(i))
                    yield pa.record_batch(
                        {"key": taken.column("key"), "words_left": np.full(len(i), l, np.int32), "hash": flat.astype(np.int64)}
                        | {c: taken.column(c) for c in ("node", "low", "high")}
                    )

    return run


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of 64-bit values, which depends on their order."""
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def _stretches(nodes: DataFrame, length: int, window: int) -> DataFrame:
    """(node, first, last) of the suffixes around which something repeats; nodes as `_NODE` after both orders."""
    least, most = F.greatest(F.lit(0), F.lit(length) - F.col("most_right")), F.least(F.lit(window - 1), F.col("most_left"))
    possible = nodes.filter(least <= most)
    unsettled = possible.filter((F.col("first") > least) | (F.col("last") < most)).select("key").distinct()
    runs = written(
        possible.join(written(unsettled, "unsettled"), "key", "left_semi").mapInArrow(
            _runs(length, window), "key long, words_left int, hash long, node binary, low long, high long"
        ),
        "runs",
    )
    by = ["key", "words_left", "hash"]
    twice = runs.groupBy(*by).agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select(*by)
    # Plain shuffles on both sides, so that a run that very many suffixes have is split at run time.
    counted = runs.join(written(twice, "twice"), by, "left_semi").select("node", F.col("words_left").alias("first"), F.col("words_left").alias("last"))
    both = possible.filter("first <= last").select("node", "first", "last").unionByName(counted)
    return both.groupBy("node").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def repeated_passages(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, start, end, n_words): stretches of words, from `start` to before `end`, of each row of docs.

    Every word of a stretch lies in `length` or more words that another document has as well; stretches that touch are
    one. n_words is the number of words of the whole text.

    * A text that several rows have is one stretch, if it is long enough; so repeated rows are reported each.
    * Texts shorter than `length` words (null, empty) are never reported, nor is what repeats only inside one text.
    * An empty table, or one without repeats, gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), body(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    described = written(
        rows.mapInArrow(_describe(length, gram, window), f"doc_id {kind}, text_key binary, n_words long, keys array<long>, places array<int>"), "described"
    )
    places = described.select("text_key", F.explode(F.arrays_zip("keys", "places")).alias("s")).select("text_key", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    # Copies give equal rows, so a hash that only one text has at one place has equal extremes.
    mark = F.xxhash64("text_key")
    # Written first: then both sides of the join are plain shuffles, and a hash that very many texts have is split.
    several = places.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low != high").select("key")
    matching = written(places.join(written(several, "several"), "key", "left_semi"), "matching")

    # One numbered row per text that matters, with its places; its words are read from one document that has it.
    wanted = matching.groupBy("text_key").agg(F.collect_set("place").alias("places"))
    owner = described.groupBy("text_key").agg(F.min("doc_id").alias("_id"))
    wanted = written(wanted.join(owner, "text_key").withColumn("number", F.monotonically_increasing_id()), "wanted")
    hashed = rows.withColumn("_key", F.unhex(F.md5("text")))
    texts = hashed.join(wanted, (hashed["_key"] == wanted["text_key"]) & hashed["doc_id"].eqNullSafe(wanted["_id"]))
    node = F.unhex(F.md5(F.concat("right", "left")))
    suffixes = written(
        texts.select("number", "text", "places")
        .mapInArrow(_suffixes(length, window), "key long, right binary, left binary, number long, place int")
        .withColumn("node", node),
        "suffixes",
    )
    # Equal suffixes are combined before the shuffle, so that a passage that very many texts have is few rows.
    nodes = suffixes.groupBy("key", "node", "right", "left").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    start = {"most_right": F.lit(0), "most_left": F.lit(0), "first": F.lit(window), "last": F.lit(-1)}
    nodes = written(nodes.withColumns(start), "nodes")
    for side, order in (("right", ["key", "right", "left"]), ("left", ["key", "left", "right"])):
        nodes = written(nodes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_extend(length, window, side), _NODE), f"by_{side}")
    found = written(_stretches(nodes, length, window), "stretches")
    found = suffixes.select("number", "node", "place").join(found, "node")
    found = found.select("number", (F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + length).alias("end"))

    # Stretches of a text, united: one begins where all before it have ended.
    inside = Window.partitionBy("number").orderBy("start", "end")
    reached = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    found = found.withColumn("stretch", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    united = found.groupBy("number", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    united = united.groupBy("number").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    united = written(united.join(wanted.select("number", "text_key"), "number").select("text_key", "spans"), "united")
    shared = described.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    facts = written(shared.join(united, "text_key", "left").filter("copies > 1 OR spans IS NOT NULL"), "facts")
    # A text may have any number of documents: two plain shuffles, so that a hot text is split at run time.
    spans = described.select("doc_id", "text_key", "n_words").join(facts, "text_key")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    spans = spans.filter(F.col("spans").isNotNull() | (F.col("n_words") >= length))
    spans = spans.select("doc_id", "n_words", F.explode(F.when((F.col("copies") > 1) & (F.col("n_words") >= length), whole).otherwise(F.col("spans"))).alias("span"))
    return spans.select("doc_id", "span.start", "span.end", "n_words")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
