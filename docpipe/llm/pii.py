"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression over one row; nothing is shuffled. Loops in the patterns are possessive and start at
the start of a run (or where the last match ended), so that no text takes more than linear time or a deep stack; what
they match is the same as with plain greedy loops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.common import body, fresh, table

BLOCK = 256
NEAR = 40
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; hint: a pattern every match contains part of, checked first; score: without context words."""

    name: str
    pattern: str
    hint: str
    score: float
    context: str


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", 0.9, "e-?mail|contact|mail"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.7, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]{2}|[0-9][ -][0-9]", 0.8, "card|visa|credit|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
)
ADDED = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Za-z0-9]*+", "[A-Z]{2}[0-9]{2}", 0.8, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"(?:\G|(?<![0-9]))[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-", 0.3, "ssn|social security|tax id"),
)
CONTEXT_BONUS = 0.3


def _only_digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether letters and digits pass the check of international account numbers."""
    moved = F.upper(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4)))
    value = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c < 65, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(value, F.lit(0), step) == 1


def _valid(kind: str, hit: Column, before: Column, after: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        digits = _only_digits(hit)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_only_digits(hit)).between(9, 15)
    apart = ~F.rlike(F.right(before, F.lit(1)), F.lit("[A-Za-z0-9]")) & ~F.rlike(F.left(after, F.lit(1)), F.lit("[A-Za-z0-9]"))
    if kind == "iban":
        return F.when(F.length(hit).between(15, 34) & apart, mod97(hit)).otherwise(False)
    if kind == "ssn":
        return apart
    return F.lit(True)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use() mentions it: a lambda over a list of one names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(hits: Column, gaps: Column) -> Column:
    """array<struct<hit, before, after, start, end>>: hits with their code-point positions, from the gaps between them.

    Positions are running sums within blocks, and of the blocks; so a text with n hits costs far less than n squared.
    """
    n = F.size(hits)
    start_of_block = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK))
    empty = "array<struct<hit:string,before:string,after:string,start:int,end:int>>"

    def in_block(first: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            before, hit = F.get(gaps, i), F.get(hits, i)
            at = state["at"] + F.length(before)
            end = at + F.length(hit)
            span = F.struct(hit.alias("hit"), before.alias("before"), F.get(gaps, i + 1).alias("after"), at.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

        return F.aggregate(
            F.sequence(first, F.least(first + BLOCK, n) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("spans")),
            add,
        )

    def add_block(state: Column, block: Column) -> Column:
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    blocks = F.transform(start_of_block, in_block)

    def shifted(blocks_: Column) -> Column:
        starts = F.aggregate(blocks_, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), add_block)["starts"]
        return F.flatten(
            F.zip_with(
                blocks_,
                starts,
                lambda b, at: F.transform(
                    b["spans"],
                    lambda s: F.struct(s["hit"].alias("hit"), s["before"].alias("before"), s["after"].alias("after"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end")),
                ),
            )
        )

    return F.when(n > 0, _once(blocks, shifted)).otherwise(F.array().cast(empty))


def _spans_of(kind: Kind, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of one kind: confirmed, and scored with the words nearby."""
    proposed = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"), F.split(text, kind.pattern, -1).alias("gaps"))
    good = F.filter(_once(proposed, lambda p: _placed(p["hits"], p["gaps"])), lambda s: _valid(kind.name, s["hit"], s["before"], s["after"]))

    def scored(s: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(s["before"], F.lit(NEAR)), F.left(s["after"], F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(rf"(?<![a-z])(?:{kind.context})(?![a-z])")), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    return F.when(F.rlike(text, F.lit(kind.hint)), F.transform(good, scored)).otherwise(
        F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    )


def find_pii(docs: DataFrame, text_column: str = "text", out: str = "pii") -> DataFrame:
    """Add the column `out`: array<struct<kind, start, end, score>>, by kind in the order of BASE and ADDED, then start.

    Positions are code points, the end is exclusive. A span whose score is under THRESHOLD is left out; base kinds are
    above it without context. Null and empty texts have no spans, every row gets its own answer, and all other columns
    stay as they are.
    """
    text = body(text_column)
    added = [F.filter(_spans_of(k, text), lambda s: s["score"] >= THRESHOLD) for k in ADDED]
    return docs.withColumn(out, F.concat(*[_spans_of(k, text) for k in BASE], *added))


def _masked(text: Column, spans: Column) -> Column:
    """text with the sorted spans (start, back = -end, kind), at least one, replaced by their kinds.

    A position is found by counting from the start of a text, so the text is cut into the stretches of sqrt(n) spans
    first and each stretch at its spans: n spans cost sqrt(n) times the text, not n times.
    """
    n = F.size(spans)
    width = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width), lambda first: F.slice(spans, first + 1, width))
    none = F.array().cast("array<struct<spans:array<struct<start:int,back:int,kind:string>>,start:int,end:int>>")

    def add_block(state: Column, block: Column) -> Column:
        end = F.greatest(state["at"], F.array_max(F.transform(block, lambda s: -s["back"])))
        cut = F.struct(block.alias("spans"), state["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["cuts"], F.array(cut)).alias("cuts"))

    def mask_block(cut: Column) -> Column:
        def mask(stretch: Column) -> Column:
            def add(state: Column, s: Column) -> Column:
                gap = F.substring(stretch, state["at"] - cut["start"] + 1, s["start"] - state["at"])
                parts = F.concat(state["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
                return F.struct(
                    F.greatest(-s["back"], state["at"]).alias("at"),
                    F.when(s["start"] < state["at"], state["parts"]).otherwise(parts).alias("parts"),
                )

            start = F.struct(cut["start"].alias("at"), F.array().cast("array<string>").alias("parts"))
            return F.aggregate(cut["spans"], start, add, lambda state: F.array_join(state["parts"], ""))

        return _once(F.substring(text, cut["start"] + 1, cut["end"] - cut["start"]), mask)

    def join(state: Column) -> Column:
        rest = F.substring(text, state["at"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(state["cuts"], mask_block), ""), rest)

    return _once(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("cuts")), add_block), join)


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Replace each span by its kind in brackets; of spans that overlap, the first (and longer) one names the whole.

    Null texts stay null. The texts between the spans are kept as they are.
    """
    name = fresh(docs, "_pii")
    found = find_pii(docs, text_column, name)
    order = F.array_sort(F.transform(name, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    masked = _once(order, lambda spans: _masked(F.col(text_column), spans))
    return found.withColumn(text_column, F.when(F.size(name) > 0, masked).otherwise(F.col(text_column))).drop(name)


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in BASE]))
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(_line(base), 256).alias("base_sha256"),
        _line(F.col("pii")).alias("spans"),
    )


def _sql() -> str:
    """The same result from patterns without look-around, positions as running sums over matches and gaps."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}[A-Za-z0-9]*",
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS hit,
               unnest(list_slice(string_split_regex(text, '{p}'), 1, -2)) AS before,
               unnest(list_slice(string_split_regex(text, '{p}'), 2, NULL)) AS after,
               unnest(range(len(regexp_extract_all(text, '{p}')))) AS i
            FROM d WHERE regexp_matches(text, '{p}')"""
        for rank, (kind, p) in enumerate(patterns.items())
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in list(patterns)[:4])
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}), placed AS (
    SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop,
        regexp_replace(hit, '[^0-9]', '', 'g') AS digits, upper(substr(hit, 5) || substr(hit, 1, 4)) AS moved,
        NOT regexp_matches(right(before, 1) || left(after, 1), '[A-Za-z0-9]') AS apart FROM found
), good AS (
    SELECT doc_id, rank, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE CASE kind
        WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
            CASE WHEN i % 2 = 0 THEN CAST(substr(reverse(digits), i + 1, 1) AS INT)
                 ELSE CAST(substr(reverse(digits), i + 1, 1) AS INT) * 2 - CASE WHEN substr(reverse(digits), i + 1, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
        WHEN 'iban' THEN apart AND length(hit) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(range(length(moved)),
            lambda i: ascii(substr(moved, i + 1, 1)))), lambda a, c: CASE WHEN c < 65 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END % 97) = 1
        WHEN 'ssn' THEN apart AND regexp_matches(lower(right(before, {NEAR}) || ' ' || left(after, {NEAR})), '(^|[^a-z])(ssn|social security|tax id)([^a-z]|$)')
        ELSE true END
), lines AS (
    SELECT doc_id, {counts},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < 4) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans
    FROM good GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lines USING (doc_id)
"""


OP10_SQL = _sql()
