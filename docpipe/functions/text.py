"""Plain text expressions: trimming, slugs, headings, sections, the merge of small sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import (
    HEADING_MAX_CHARS,
    HEADING_MIN_CHARS,
    INLINE_LIMIT_BYTES,
    KEY_CHARS,
    MIN_SECTION_CHARS,
    SPACE,
    SPACE_CLASS,
)
from docpipe.functions.arrays import let

# Fixed values. How a heading line starts: a section number, a named part with a number, or a customary title.
HEADING_START = (
    rf"(?i)^(?:\d++(?:\.\d++)*+\.?[{SPACE_CLASS}]"
    rf"|(?:chapter|section|part|appendix)[{SPACE_CLASS}]++\d"
    r"|abstract|introduction|background|method|result|discussion|conclusion|references|acknowledgment)"
)


def trim(text: Column) -> Column:
    """Trim all Unicode white space, not only U+0020."""
    return F.trim(text, F.lit(SPACE))


def trim_long(text: Column) -> Column:
    """``trim`` for long texts: the copy is made only if an edge needs it. ``text`` should be a bound value."""
    return F.when(text.rlike(rf"^[{SPACE_CLASS}]|[{SPACE_CLASS}]\z"), trim(text)).otherwise(text)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE_CLASS}]")


def decode_utf8(body: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD and a BOM is kept."""
    return F.make_valid_utf8(body.cast("string"))


def is_large(content: Column, limit: int = INLINE_LIMIT_BYTES) -> Column:
    return F.octet_length(content) > limit


def slug(title: Column) -> Column:
    """Chunk key of a title."""
    words = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_")
    key = F.substring(F.regexp_replace(words, "^_|_$", ""), 1, KEY_CHARS)
    return F.when(key == "", "section").otherwise(key)


def is_heading(line: Column) -> Column:
    """Whether an already trimmed line looks like a heading."""
    return F.length(line).between(HEADING_MIN_CHARS, HEADING_MAX_CHARS) & (
        ((F.length(line) > 3) & (line == F.upper(line))) | line.rlike(HEADING_START)
    )


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk(key: Column, title: Column, content: Column) -> Column:
    return F.struct(key.alias("key"), title.alias("title"), content.alias("content"))


def text_sections(text: Column) -> Column:
    """Array of (key, title, content) between heading lines, empty sections left out."""

    def mark(line: Column) -> Column:
        # Looks at every line once; the trimmed text is only kept as a possible title.
        return let(
            trim(line),
            lambda t: F.struct(
                line.alias("line"), F.when(is_heading(t), t).alias("title"), (t == "").alias("blank")
            ),
        )

    def cut(rows: Column) -> Column:
        headings = F.filter(
            F.transform(rows, lambda row, i: F.when(row["title"].isNotNull(), i)), lambda i: i.isNotNull()
        )
        return let(headings, lambda at: between(rows, at))

    def between(rows: Column, at: Column) -> Column:
        # Section k runs from after heading k - 1 up to heading k; the first one has no heading.
        starts = F.concat(F.array(F.lit(-1)), at)
        ends = F.concat(at, F.array(F.size(rows)))
        return F.transform(
            F.arrays_zip(starts.alias("start"), ends.alias("end")),
            lambda s: F.struct(
                F.when(s["start"] < 0, "introduction").otherwise(F.get(rows, s["start"])["title"]).alias("title"),
                let(
                    F.array_join(
                        F.transform(
                            F.filter(
                                F.slice(rows, s["start"] + 2, s["end"] - s["start"] - 1),
                                lambda row: ~row["blank"],
                            ),
                            lambda row: row["line"],
                        ),
                        "\n",
                    ),
                    trim_long,
                ).alias("content"),
            ),
        )

    found = F.filter(let(F.transform(lines(text), mark), cut), lambda s: s["content"] != "")
    return F.transform(found, lambda s: chunk(slug(s["title"]), s["title"], s["content"]))


def text_paragraphs(text: Column) -> Column:
    """Array of (key, title, content), one per paragraph."""
    parts = F.filter(F.split(text, "\n\n+", -1), lambda p: ~is_blank(p))
    return F.transform(
        parts,
        lambda p, i: chunk(
            F.concat(F.lit("para_"), i.cast("string")),
            F.concat(F.lit("paragraph "), (i + 1).cast("string")),
            trim_long(p),
        ),
    )


def merge_small(sections: Column, min_chars: int = MIN_SECTION_CHARS) -> Column:
    """Merge sections that are short, or follow a short one, into their predecessor.

    Walking left to right, a section starts a new group only if the group before it has reached ``min_chars``
    and it is that long itself. Every group but the first starts with a long section, so the first condition
    can only fail inside the first group: it is enough to find the position from which the running length
    (joined by blank lines) is long enough, and to cut at the long sections from there on.
    """

    def cut(items: Column) -> Column:
        start = F.struct(
            F.lit(0).cast("long").alias("chars"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("first")
        )

        def step(acc: Column, item: Column) -> Column:
            chars = acc["chars"] + F.length(item["content"])
            seen = acc["seen"] + 1
            reached = chars + 2 * (seen - 1) >= min_chars
            return F.struct(
                chars.alias("chars"),
                seen.alias("seen"),
                F.coalesce(acc["first"], F.when(reached, seen)).alias("first"),
            )

        first = F.aggregate(items, start, step, lambda acc: acc["first"])
        return let(
            first,
            lambda f: let(
                F.filter(
                    F.transform(
                        items, lambda item, i: F.when((i >= f) & (F.length(item["content"]) >= min_chars), i)
                    ),
                    lambda i: i.isNotNull(),
                ),
                lambda at: groups(items, at),
            ),
        )

    def groups(items: Column, at: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), at)
        ends = F.concat(at, F.array(F.size(items)))
        return F.transform(
            F.arrays_zip(starts.alias("start"), ends.alias("end")),
            lambda s: let(
                F.slice(items, s["start"] + 1, s["end"] - s["start"]),
                lambda part: chunk(
                    F.get(part, F.lit(0))["key"],
                    F.get(part, F.lit(0))["title"],
                    F.array_join(F.transform(part, lambda item: item["content"]), "\n\n"),
                ),
            ),
        )

    return let(sections, lambda items: F.when(F.size(items) <= 1, items).otherwise(cut(items)))


def text_chunks(text: Column, min_chars: int = MIN_SECTION_CHARS) -> Column:
    """Sections with small ones merged; paragraphs if no section has content."""
    return let(
        text_sections(text),
        lambda found: F.when(F.size(found) == 0, text_paragraphs(text)).otherwise(merge_small(found, min_chars)),
    )
