"""Quality rules of documents and of their hosts.

Rules look at each text; their failures are counted per host, the rates are shrunk towards the rate of all hosts by a
beta prior fitted to the hosts, and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, text_hash, written
from docpipe.llm.words import blocks, grams, repeated, sums, words

WINDOW = 8
#: A host is rejected if the shrunk rate of any rule is above its limit.
HOST_LIMITS = {"base": 0.9, "symbols": 0.9, "lines": 0.9}
STATISTICS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line of their text, counted per text."""
    raw = data.tobytes()
    counts = []
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        lines = [x for x in raw[start:end].split(b"\n") if x and not x.isspace()]
        counts.append((len(lines), len(lines) - len(set(lines))))
    return tuple(np.array(counts, np.int64).reshape(-1, 2).T)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            found = words(data, offsets)
            nw = len(found.hashes)
            # Code points: all bytes but those that continue one.
            chars = sums(((data & 0xC0) != 0x80) & ~np.isin(data, list(b"\x20\t\n\x0b\x0c\r")), offsets)
            gram, at = grams(found, WINDOW)
            owner = found.text_of()
            again = at[repeated(gram, owner[at])]
            cover = np.zeros(nw + 1, np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, np.minimum(again + WINDOW, nw), -1)
            n_lines, repeated_lines = _lines(data, offsets)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "host": part.column("host"),
                    "text_hash": part.column("text_hash"),
                    "n_words": found.counts.astype(np.int64),
                    "word_chars": chars,
                    "n_symbols": sums(_SYMBOL[data], offsets),
                    "n_lines": n_lines,
                    "n_dup_lines": repeated_lines,
                    "n_repeat_words": sums(np.cumsum(cover)[:nw] > 0, found.bounds),
                }
            )


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """One row per document: doc_id, host, text_hash, and the counts of STATISTICS over its whole text (null: none)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(host_column).cast("string").alias("host"), text_hash(text_column).alias("text_hash"), body(text_column).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_statistics, f"doc_id {kinds['doc_id']}, host string, text_hash long, {STATISTICS}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def failures() -> dict[str, Column]:
    """Rules of a document whose failures are counted per host."""
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


@dataclass(frozen=True)
class Prior:
    """A beta distribution of rates."""

    alpha: float
    beta: float


def fit_prior(hosts: DataFrame, rule: str) -> Prior:
    """Fit the prior of one rule to the hosts by moments; each host counts once.

    The spread of the rates is lessened by what chance alone gives hosts of their sizes. Where no spread is left, or
    there are fewer than two hosts, the prior weighs as much as a hundred documents.
    """
    rate = F.col(rule) / F.col("n")
    row = hosts.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("spread"), F.avg(1 / F.col("n")).alias("small")).first()
    mean = row["mean"] or 0.0
    chance = mean * (1 - mean)
    excess = (row["spread"] or 0.0) - chance * (row["small"] or 0.0)
    weight = chance / excess - 1 if excess > 0 else 100.0
    weight = min(max(weight, 1.0), 10_000.0)
    return Prior(mean * weight + 1e-6, (1 - mean) * weight + 1e-6)


def host_verdicts(counted: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(host, n, shrunk rate of each rule, host_ok) from statistics(). Documents without host form one host."""
    limits = limits or HOST_LIMITS
    rules = failures()
    hosts = written(counted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(rules[r].cast("long")).alias(r) for r in limits]), "hosts")
    priors = {r: fit_prior(hosts, r) for r in limits}
    shrunk = {r: (F.col(r) + p.alpha) / (F.col("n") + p.alpha + p.beta) for r, p in priors.items()}
    ok = F.lit(True)
    for r, limit in limits.items():
        ok &= shrunk[r] <= limit
    return hosts.select("host", "n", *[c.alias(f"rate_{r}") for r, c in shrunk.items()], ok.alias("host_ok"))


def quality_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Statistics and verdict of each row of docs (doc_id, text, source, ...): base_failed, host_ok, kept.

    Null, empty and blank texts have no words and fail. Repeated rows are judged alike and count as often as they occur.
    A null source is a host of its own. An empty table gives an empty result.
    """
    counted = written(statistics(docs, **columns), "statistics")
    verdicts = host_verdicts(counted).select(F.col("host").alias("_host"), "host_ok")
    judged = counted.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    failed = base_failed()
    return judged.select("*", failed.alias("base_failed"), (~failed & F.col("host_ok")).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def prior(rule: str) -> str:
        return f"""(SELECT {{part}} FROM (SELECT mean, CASE WHEN excess > 0
            THEN least(greatest(mean * (1 - mean) / excess - 1, 1), 10000) ELSE 100 END AS w FROM (
                SELECT avg({rule} / n) AS mean, coalesce(var_samp({rule} / n), 0) - avg({rule} / n) * (1 - avg({rule} / n)) * avg(1 / n) AS excess FROM hosts)))"""

    ok = " AND ".join(
        f"({r} + {prior(r).format(part='mean * w + 1e-6')}) / (n + {prior(r).format(part='w + 2e-6')}) <= {limit}"
        for r, limit in HOST_LIMITS.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
        generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d
), runs AS (
    SELECT *, count(*) OVER r AS long, string_agg(word, ' ') OVER r AS run FROM w
    WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), twice AS (
    SELECT doc_id, i, word, long = {WINDOW} AND count(*) OVER (PARTITION BY doc_id, run, long) > 1 AS again FROM runs
), covered AS (
    SELECT doc_id, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS inside FROM twice
), counted AS (
    SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY doc_id
), all_docs AS (
    SELECT d.doc_id, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN counted USING (doc_id)
), judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM all_docs
), hosts AS (
    SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS base, count(*) FILTER (10 * n_symbols > word_chars) AS symbols,
        count(*) FILTER (2 * n_dup_lines > n_lines) AS lines FROM judged GROUP BY source
), good AS (SELECT source, {ok} AS host_ok FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM judged LEFT JOIN good ON judged.source IS NOT DISTINCT FROM good.source
"""


OP5_SQL = _sql()
