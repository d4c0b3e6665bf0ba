"""HTML as a token job: Markdown, links, sections by heading.

clean -> one exchange of whole documents -> tokens -> running sums in document order -> blocks or sections -> text.
Every window and grouping key starts with the document keys, so that single exchange serves all of them. A document
is bounded by the response size limit, which bounds the work of a task.

Fragments carry control characters until their block is complete, because what they turn into depends on the
block: 01/02 strong, 03/04 emphasis, 0E/0F code, 05/06..07 link (open, target), 0B line break. A closing mark is
written only where its block has such a mark open, to any depth, so that marks nest like brackets; those that a block
leaves open are closed at its end. The same characters in a page are hidden behind 10 until the block is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions import html as H
from docpipe.functions.arrays import let, ordered_concat
from docpipe.functions.text import chunk, is_blank, slug, trim, trim_long
from docpipe.operators.common import ROW, by_document, explode_chunks, in_order

# Tags that open and close a mark.
PAIRED = {"strong": H.STRONG_TAGS, "emphasis": H.EMPHASIS_TAGS, "code": ["code"]}


def html_body(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return df.select(id_col, F.expr(H.clean_html(html_col)).alias("body"))


def html_tokens(
    df: DataFrame, keys: Sequence[str] = ("page_id",), html_col: str = "html", distribute: bool = True
) -> DataFrame:
    """Tokens of the body in document order, with tag and kind.

    ``distribute=False`` is for input that is already partitioned by (a prefix of) the keys. Position 0 is an
    empty text, so that empty documents stay in the result.
    """
    docs = by_document(df.select(*keys, F.expr(H.clean_html(html_col)).alias("body")), keys, distribute)
    tokens = F.concat(F.array(F.lit("")), F.expr(H.html_tokens("body")))
    return (
        docs.select(*keys, ROW, F.posexplode(tokens).alias("pos", "token"))
        .withColumn("tag", F.expr(H.tag_name("token")))
        .withColumn("kind", F.expr(H.tag_kind("token", "tag")))
    )


def html_tag_counts(df: DataFrame, html_col: str = "html") -> DataFrame:
    """How often every tag occurs and how it is treated. Counts are combined before the shuffle."""
    return (
        df.select(F.explode(F.expr(H.html_tokens(H.clean_html(html_col)))).alias("token"))
        .withColumn("tag", F.expr(H.tag_name("token")))
        .filter(F.col("tag").isNotNull())
        .groupBy("tag")
        .agg(
            F.count("*").alias("n_tags"),
            F.count_if(F.startswith("token", F.lit("</"))).alias("n_closing"),
        )
        .withColumn(
            "role",
            F.when(F.col("tag").isin(H.BLOCK_TAGS), "block")
            .when(F.col("tag").isin(H.VOID_TAGS), "void")
            .otherwise("inline"),
        )
    )


def _depths(tokens: DataFrame, keys: Sequence[str], tags: dict[str, list[str]]) -> DataFrame:
    """Adds ``<name>_depth``: how many of the tags are open after the token. Closing what is not open does nothing."""
    running = in_order(keys, "pos")
    steps = {
        name: F.when(F.col("tag").isin(names), F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1))
        for name, names in tags.items()
    }
    sums = tokens.select(
        "*", *[F.coalesce(F.sum(s).over(running), F.lit(0)).alias(f"{name}_sum") for name, s in steps.items()]
    )
    return sums.select(
        *tokens.columns,
        *[
            (F.col(f"{name}_sum") - F.least(F.lit(0), F.min(f"{name}_sum").over(running))).cast("int").alias(f"{name}_depth")
            for name in tags
        ],
    )


def _strays(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``<mark>_stray``: whether the token closes a mark that is not open in its block.

    The number of open marks runs through the whole document; a closing tag is stray where it falls below all
    earlier numbers of its block. Blocks are numbered in document order, so the lowest number of the current block is
    a running maximum of (block, -number), packed in one integer.
    """
    running = in_order(keys, "pos")
    earlier = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = {
        name: F.when(
            (F.col("pre_depth") == 0) & F.col("tag").isin(names),
            F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1),
        )
        for name, names in PAIRED.items()
    }
    block = F.shiftleft(F.col("block").cast("long"), 32)
    counted = tokens.select(
        "*",
        *[F.coalesce(step, F.lit(0)).alias(f"{name}_step") for name, step in steps.items()],
        *[F.coalesce(F.sum(step).over(running), F.lit(0)).alias(f"{name}_open") for name, step in steps.items()],
    )

    def lowest(name: str) -> Column:
        return block + 2**31 - (F.col(f"{name}_open") - F.greatest(F.col(f"{name}_step"), F.lit(0)))

    return counted.select(
        *tokens.columns,
        *[
            ((F.col(f"{name}_step") < 0) & (lowest(name) > F.coalesce(F.max(lowest(name)).over(earlier), F.lit(0)))).alias(f"{name}_stray")
            for name in PAIRED
        ],
    )


def _with_title(opening: str, target: str, closing: str) -> str:
    """Target of a link or image, with the title if it has one; null without a target."""
    title = H.bind(H.attribute("token", "title"), "title", """CASE WHEN title <> '' THEN concat(' "', title, '"') ELSE '' END""")
    return H.bind(
        H.attribute("token", target),
        "target",
        f"CASE WHEN target <> '' THEN concat({opening}, target, {title}, '{closing}') END",
    )


LINK_TARGET = _with_title("''", "href", "")
IMAGE = f"""coalesce({_with_title("'![', " + H.attribute("token", "alt") + ", ']('", "src", ")")}, '')"""


def _closing(name: str, start: str, end: str) -> str:
    return f"CASE WHEN kind = 'open' THEN '{start}' WHEN {name}_stray THEN '' ELSE '{end}' END"


# What a token adds to the text of its block.
FRAGMENT = f"""
CASE
  WHEN kind = 'text' AND pre_depth > 0 THEN {H.hide_marks(H.decode_entities("token"))}
  WHEN kind = 'text' AND in_code THEN {H.hide_marks(H.decoded_text("token"))}
  WHEN kind = 'text' THEN {H.hide_marks(H.escape_markdown(H.decoded_text("token"), "starts_block"))}
  WHEN tag = 'br' THEN CASE WHEN pre_depth > 0 THEN '\n' ELSE '\x0b' END
  WHEN pre_depth > 0 AND tag <> 'pre' THEN ''
  WHEN tag = 'hr' THEN '* * *'
  WHEN {H.either("tag", H.STRONG_TAGS)} THEN {_closing("strong", "\x01", "\x02")}
  WHEN {H.either("tag", H.EMPHASIS_TAGS)} THEN {_closing("emphasis", "\x03", "\x04")}
  WHEN tag = 'code' THEN {_closing("code", "\x0e", "\x0f")}
  WHEN tag = 'img' THEN {H.hide_marks(IMAGE)}
  WHEN tag = 'a' THEN concat(
    CASE WHEN link_before IS NOT NULL THEN concat('\x06', link_before, '\x07') ELSE '' END,
    CASE WHEN link_after IS NOT NULL THEN '\x05' ELSE '' END)
  ELSE ''
END
"""


def html_blocks(
    df: DataFrame, keys: Sequence[str] = ("page_id",), html_col: str = "html", distribute: bool = True
) -> DataFrame:
    """Blocks in document order: raw text with marks, and where the block stands."""
    kind, tag, token = F.col("kind"), F.col("tag"), F.col("token")
    source = html_tokens(df, keys, html_col, distribute)
    keys = [*keys, ROW]
    running = in_order(keys, "pos")
    at = Window.partitionBy(*keys).orderBy("pos")
    earlier = at.rowsBetween(Window.unboundedPreceding, -1)

    tokens = _depths(source, keys, {"list": ["ul", "ol"], "quote": ["blockquote"], "pre": ["pre"]})
    # A block tag starts a new block, except inside preformatted text; so does what follows a rule.
    boundary = (
        F.coalesce(tag.isin(H.BLOCK_TAGS), F.lit(False)) & ((F.col("pre_depth") == 0) | (tag == "pre"))
    ) | F.coalesce(F.lag("tag").over(at) == "hr", F.lit(False))
    # State of links: a tag <a> sets the target (or none), </a> resets it.
    link = F.when(tag == "a", F.struct(F.when(kind == "open", F.expr(H.hide_marks(LINK_TARGET))).alias("target")))
    code = F.when((tag == "code") & kind.isin("open", "close"), F.struct((kind == "open").alias("open"), "pos"))
    tokens = tokens.select(
        "*", boundary.alias("boundary"), link.alias("link"), code.alias("code"),
        ((kind == "text") & ~is_blank(token)).alias("has_text"),
    )
    tokens = tokens.select(
        "*",
        F.sum(F.col("boundary").cast("int")).over(running).cast("int").alias("block"),
        F.max(F.when(F.col("boundary"), F.col("pos"))).over(running).alias("block_pos"),
        F.max(F.when(F.col("has_text"), F.col("pos"))).over(earlier).alias("text_pos"),
        F.last("link", ignorenulls=True).over(earlier)["target"].alias("link_before"),
        F.last("link", ignorenulls=True).over(running)["target"].alias("link_after"),
        F.last("code", ignorenulls=True).over(earlier).alias("code_before"),
    )

    block_pos = F.coalesce(F.col("block_pos"), F.lit(0))
    tokens = tokens.withColumns(
        {
            "in_code": F.coalesce(F.col("code_before.open") & (F.col("code_before.pos") > block_pos), F.lit(False)),
            "starts_block": F.coalesce(F.col("text_pos") < block_pos, F.lit(True)),
        }
    )
    tokens = _strays(tokens, keys)
    # A link that is open where a block ends is closed there and opened again in the next block.
    reopened = F.when(F.col("boundary") & F.col("link_before").isNotNull(), "\x05").otherwise("")
    fragment = F.concat(reopened, F.expr(FRAGMENT))

    starts = F.col("boundary") & F.coalesce(tag.isin(H.BLOCK_TAGS), F.lit(False))
    is_open = starts & (kind != "close")
    language = F.regexp_extract(token, r"""(?i)\sclass\s*=\s*["']?[^"'>]*?language-([^\s"'>]+)""", 1)
    first_number = F.regexp_extract(token, r"""(?i)\sstart\s*=\s*["']?(-?[0-9]+)""", 1).try_cast("bigint")
    return tokens.groupBy(*keys, "block").agg(
        F.max(F.when(is_open, tag)).alias("tag"),
        F.coalesce(F.max(F.when(F.col("boundary"), F.col("list_depth"))), F.lit(0)).alias("list_depth"),
        F.coalesce(F.max(F.when(F.col("boundary"), F.col("quote_depth"))), F.lit(0)).alias("quote_depth"),
        F.max(F.when(is_open & (tag == "ol"), first_number)).alias("start"),
        F.max(F.when((F.col("pre_depth") > 0) & (tag == "code") & (kind == "open"), language)).alias("language"),
        F.max(F.struct("pos", F.col("link_after").alias("target")))["target"].alias("open_link"),
        ordered_concat(F.col("pos"), fragment).alias("raw"),
    )


def _without_empty(text: str) -> str:
    """Marks around nothing are removed, and what is empty then, until none is left.

    Only marks side by side can become empty, so the levels are gone through within each run of marks, not over the
    words between the runs.
    """
    empty = ("\x01\x02", "\x03\x04", "\x0e\x0f")
    either = "|".join(empty)
    marks = "".join(empty)
    rounds = "length(p) div 2"
    shorter = H.bind(f"regexp_replace(a.rest, '{either}', '')", "r", "named_struct('rest', r, 'more', length(r) < length(a.rest))")
    loop = (
        f"aggregate(sequence(1, {rounds}), named_struct('rest', p, 'more', true), "
        f"(a, i) -> CASE WHEN a.more THEN {shorter} ELSE a END, a -> a.rest)"
    )
    first = ", ".join(f"'{mark}'" for mark in marks)
    run = f"CASE WHEN substr(p, 1, 1) IN ({first}) AND {H.has('p', *empty)} THEN {loop} ELSE p END"
    pieces = f"regexp_extract_all({text}, '[{marks}]++|[^{marks}]++', 0)"
    return f"CASE WHEN {H.has(text, *empty)} THEN array_join(transform({pieces}, p -> {run}), '') ELSE {text} END"


def _block_text_sql() -> str:
    """Markdown of the marked-up text of one block, from the columns raw and open_link.

    A pattern goes through the whole text, so each is tried only where what it is about occurs.
    """

    def regexp(t: str, where: Sequence[str], pattern: str, new: str) -> str:
        return H.bind(t, "s", f"CASE WHEN {H.has('s', *where)} THEN regexp_replace(s, '{pattern}', '{new}') ELSE s END")

    # A link still open at the end of the block is closed there.
    text = "concat(raw, CASE WHEN open_link IS NOT NULL THEN concat('\x06', open_link, '\x07') ELSE '' END)"
    # Space moves out of the marks, empty marks and links go away. Each run is looked at once, from its start.
    marks = regexp("t", ["\x01 ", "\x03 ", "\x05 "], "(?<![\x01\x03\x05])([\x01\x03\x05]++) +", " $1")
    marks = regexp(marks, [" \x02", " \x04"], "(?<! ) ++([\x02\x04]+)", "$1 ")
    marks = H.bind(marks, "e", _without_empty("e"))
    marks = regexp(marks, ["\x05"], "\x05( *)\x06[^\x07]*\x07", "$1")
    marks = regexp(regexp(marks, ["  "], " {2,}", " "), ["\x0b"], " *\x0b *", "\x0b")
    marks = f"rtrim(' \x0b\x01\x03\x0e', ltrim(' \x0b', {marks}))"
    # What is open is closed at the end of the block: every closing mark has its opening one.
    paired = (("\x0e", "\x0f", "`"), ("\x03", "\x04", "_"), ("\x01", "\x02", "**"))
    still_open = [
        f"repeat('{out}', size(filter(q, p -> p = '{start}')) - size(filter(q, p -> p = '{end}')))" for start, end, out in paired
    ]
    written = {mark: out for start, end, out in paired for mark in (start, end)}
    written |= {"\x05": "[", "\x06": "](", "\x07": ")", "\x0b": "  \\n"}
    cases = " ".join(f"WHEN '{mark}' THEN '{out}'" for mark, out in written.items())
    piece = f"CASE WHEN contains('{H.MARKS}', substr(p, 1, 1)) THEN CASE p {cases} END ELSE p END"
    closed = f"concat(array_join(transform(q, p -> {piece}), ''), {', '.join(still_open)})"
    marked = H.bind(f"regexp_extract_all({marks}, '[{H.MARKS}]|[^{H.MARKS}]++', 0)", "q", closed)
    plain = f"trim({regexp('t', ['  '], ' {2,}', ' ')})"
    return H.bind(text, "t", f"CASE WHEN t RLIKE '[{H.MARKS}]' THEN {marked} ELSE {plain} END")


BLOCK_TEXT = _block_text_sql()


def _code_block(raw: Column, language: Column) -> Column:
    """Fenced text; the line break after the opening tag does not count."""
    body = F.regexp_replace(F.regexp_replace(raw, r"^\r?\n", ""), r"\s+\z", "")
    fenced = F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), body, F.lit("\n```"))
    return F.when(is_blank(raw), "").otherwise(fenced)


def _markdown_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the list item numbers, the prefix of every line and the separator before the block."""
    keys = [*keys, ROW]
    tag = F.col("tag")
    order = Window.partitionBy(*keys).orderBy("block")
    running = in_order(keys, "block")
    level = in_order([*keys, "list_depth"], "block")
    list_open = tag.isin("ul", "ol")
    is_item = tag == "li"

    blocks = blocks.select(
        *keys, "block", "tag", "quote_depth", "start",
        F.when(is_item & (F.col("list_depth") == 0), 1).otherwise(F.col("list_depth")).alias("list_depth"),
        let(
            F.when(tag == "pre", _code_block(F.col("raw"), F.col("language"))).otherwise(F.expr(BLOCK_TEXT)),
            H.shown_marks,
        ).alias("text"),
    )
    blocks = blocks.select(
        "*",
        F.sum(F.when(is_item, 1).otherwise(0)).over(running).alias("item"),
        F.sum(F.when(list_open & (F.col("list_depth") == 1), 1).otherwise(0)).over(running).alias("outer_list"),
        F.sum(F.when((tag == "blockquote") & (F.col("quote_depth") == 1), 1).otherwise(0)).over(running).alias("outer_quote"),
        F.sum(F.when(is_item, 1).otherwise(0)).over(level).alias("items_on_level"),
        F.last(F.when(list_open, tag), ignorenulls=True).over(level).alias("list_tag"),
        F.last(F.when(list_open, F.struct(F.coalesce("start", F.lit(1).cast("bigint")).alias("n"))), ignorenulls=True).over(level)["n"].alias("first_no"),
    ).withColumn(
        "items_before", F.last(F.when(list_open, F.col("items_on_level")), ignorenulls=True).over(level)
    )
    # Blank blocks have done their part; block 0 stays, so that every document has a row.
    blocks = blocks.filter((F.col("text") != "") | (F.col("block") == 0))

    def before(name: str) -> Column:
        return F.lag(name).over(order)

    blocks = blocks.select(
        "*",
        before("text").alias("prev_text"),
        before("item").alias("prev_item"),
        before("outer_list").alias("prev_list"),
        before("list_depth").alias("prev_list_depth"),
        before("outer_quote").alias("prev_quote"),
        before("quote_depth").alias("prev_quote_depth"),
    )
    in_list = F.col("list_depth") > 0
    first_of_item = in_list & (F.col("item") > F.coalesce("prev_item", F.lit(0)))
    number = F.col("items_on_level") - F.coalesce("items_before", F.lit(0)) + F.coalesce("first_no", F.lit(1)) - 1
    bullet = F.when(F.col("list_tag") == "ol", F.concat(number.cast("string"), F.lit(".  "))).otherwise("*   ")
    indent = F.repeat(F.lit("    "), F.col("list_depth") - 1)
    follow = F.repeat(F.lit("    "), F.col("list_depth"))
    quote = F.repeat(F.lit("> "), F.col("quote_depth"))
    head = F.when(first_of_item, F.concat(indent, bullet)).when(in_list, follow).otherwise("")
    level_of_heading = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(0)
    hashes = F.when(level_of_heading > 0, F.concat(F.repeat(F.lit("#"), level_of_heading), F.lit(" "))).otherwise("")
    line_start = F.concat(F.lit("\n"), quote, F.when(in_list, follow).otherwise(""))
    content = F.concat(quote, head, hashes, F.replace(F.col("text"), F.lit("\n"), line_start))

    same_list = in_list & (F.col("prev_list_depth") > 0) & (F.col("outer_list") == F.col("prev_list"))
    shared = F.least("quote_depth", "prev_quote_depth")
    same_quote = (shared > 0) & (F.col("outer_quote") == F.col("prev_quote"))
    separator = (
        F.when(F.coalesce(F.col("prev_text"), F.lit("")) == "", "")
        .when(first_of_item & same_list, "\n")
        .when(same_quote, F.concat(F.lit("\n"), F.repeat(F.lit("> "), shared), F.lit("\n")))
        .otherwise("\n\n")
    )
    return blocks.select(*keys, "block", "tag", "text", F.when(F.col("text") == "", "").otherwise(F.concat(separator, content)).alias("markdown"))


def html_to_markdown(
    df: DataFrame, keys: Sequence[str] = ("page_id",), html_col: str = "html", distribute: bool = True
) -> DataFrame:
    """Markdown of every document, '' for an empty one."""
    blocks = _markdown_blocks(html_blocks(df, keys, html_col, distribute), keys)
    return (
        blocks.groupBy(*keys, ROW).agg(ordered_concat(F.col("block"), F.col("markdown")).alias("markdown")).drop(ROW)
    )


def markdown_blocks(df: DataFrame, keys: Sequence[str] = ("page_id",), html_col: str = "html") -> DataFrame:
    """The blocks with text: tag that starts the block, and its Markdown without prefixes."""
    blocks = _markdown_blocks(html_blocks(df, keys, html_col), keys)
    return blocks.filter(F.col("text") != "").select(*keys, "block", "tag", "text")


def html_links(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Anchors with a target: number in the page, target, text."""
    tag, kind = F.col("tag"), F.col("kind")
    running = in_order([id_col, ROW], "pos")
    href = F.when((tag == "a") & (kind == "open"), F.expr(H.attribute("token", "href")))
    tokens = html_tokens(df, [id_col], html_col).withColumn("href", F.when(href != "", href))
    tokens = tokens.select(
        "*",
        F.sum(F.col("href").isNotNull().cast("int")).over(running).cast("int").alias("link_no"),
        F.last(F.when(tag == "a", F.col("href").isNotNull()), ignorenulls=True).over(running).alias("inside"),
    )
    text = F.when(kind == "text", F.expr(H.decoded_text("token"))).when(tag == "br", " ").otherwise("")
    return (
        tokens.filter("inside")
        .groupBy(id_col, ROW, "link_no")
        .agg(F.max("href").alias("href"), ordered_concat(F.col("pos"), text).alias("text"))
        .select(id_col, "link_no", "href", trim(F.regexp_replace("text", " {2,}", " ")).alias("text"))
    )


def html_sections(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Chunks between the headings (h1 to h3) that are children of the body; HTML content.

    A heading ends the section before it and gives the title of the next one. The other children contribute what
    is inside them, texts their text; blank ones are left out and so are sections without content.
    """
    keys = [id_col, ROW]
    tag, kind, token = F.col("tag"), F.col("kind"), F.col("token")
    running = in_order(keys, "pos")
    inline_step = F.when(~tag.isin(H.BLOCK_TAGS), F.when(kind == "open", 1).when(kind == "close", -1))
    tokens = _depths(html_tokens(df, [id_col], html_col), keys, {"container": H.CONTAINER_TAGS}).select(
        "*",
        F.coalesce(tag.isin(H.BLOCK_TAGS), F.lit(False)).alias("is_block"),
        F.coalesce(tag.isin(H.CONTAINER_TAGS), F.lit(False)).alias("is_container"),
    )
    heading = tag.isin("h1", "h2", "h3") & (kind == "open") & (F.col("container_depth") == 0)
    tokens = tokens.select(
        "*",
        F.coalesce(heading, F.lit(False)).alias("heading"),
        F.coalesce(F.sum(inline_step).over(running), F.lit(0)).alias("inline_sum"),
    )
    # What the last block tag on top level leaves open: a heading, another element, or nothing.
    top = F.col("container_depth") == 0
    event = F.when(
        F.col("is_block") & (kind != "void"),
        F.struct(
            F.when(F.col("heading"), "heading").when((kind == "open") & ~F.col("is_container"), "element").alias("inside"),
            F.col("inline_sum").alias("inline_sum"),
        ),
    )
    tokens = tokens.select(
        "*",
        F.last(event, ignorenulls=True).over(running).alias("last_block"),
        F.sum(F.col("heading").cast("int")).over(running).cast("int").alias("section"),
    )
    inside = F.col("last_block.inside")
    inline_depth = F.col("inline_sum") - F.coalesce(F.col("last_block.inline_sum"), F.lit(0))
    inline_tag = tag.isNotNull() & ~F.col("is_block") & (kind != "void")
    in_heading = top & F.coalesce(inside == "heading", F.lit(False))
    bare = top & inside.isNull()
    # Tags that separate the children of the body; they are not part of any content.
    container_edge = F.col("is_container") & (
        ((kind == "open") & (F.col("container_depth") == 1)) | ((kind == "close") & top)
    )
    edge = (
        container_edge
        | (top & F.col("is_block"))
        | (bare & (kind == "void"))
        | (bare & inline_tag & (((kind == "open") & (inline_depth == 1)) | ((kind == "close") & (inline_depth <= 0))))
    )
    top_text = bare & (kind == "text") & (inline_depth <= 0)
    # Nothing is lost: what is no content stands between 01 and 02, the source of a decoded text before it between
    # 03 and 02 and the text up to 04. Pages without content are put together again from that.
    # The same characters in the page are hidden meanwhile.
    hidden = F.expr(H.hide_marks("token"))
    decoded = F.expr(H.decode_entities("token"))
    fragment = (
        F.when(edge | in_heading, F.concat(F.lit("\x01"), hidden, F.lit("\x02")))
        .when(top_text, F.concat(F.lit("\x03"), hidden, F.lit("\x02"), F.expr(H.hide_marks(H.decode_entities("token"))), F.lit("\x04")))
        .otherwise(hidden)
    )
    title_part = F.when(in_heading & (kind == "text"), decoded).otherwise("")
    visible = F.translate(F.regexp_replace("raw", "\x03[^\x02]*\x02", ""), "\x04", "")
    parts = F.filter(F.split(visible, "\x01[^\x02]*\x02", -1), lambda p: ~is_blank(p))
    source = F.regexp_replace(
        F.regexp_replace("raw", "\x03([^\x02]*)\x02[^\x04]*\x04", "$1"), "\x01([^\x02]*)\x02", "$1"
    )
    sections = (
        tokens.groupBy(*keys, "section")
        .agg(
            ordered_concat(F.col("pos"), fragment).alias("raw"),
            ordered_concat(F.col("pos"), title_part).alias("raw_title"),
        )
        .select(
            *keys,
            "section",
            F.when(F.col("section") == 0, "content").otherwise(trim(F.col("raw_title"))).alias("title"),
            let(let(F.array_join(parts, "\n"), H.shown_marks), trim_long).alias("content"),
            let(source, H.shown_marks).alias("source"),
        )
        .select("*", F.when(F.col("content") == "", F.col("source")).alias("empty"))
    )
    rows = F.sort_array(F.collect_list(F.struct("section", "title", "content", "empty")))

    def chunks(all_rows: Column) -> Column:
        found = F.transform(
            F.filter(all_rows, lambda r: r["content"] != ""),
            lambda r: let(
                F.when(r["title"] == "", "section").otherwise(r["title"]),
                lambda title: chunk(slug(title), title, r["content"]),
            ),
        )
        # No content between headings at all: the body as it is.
        body = F.array_join(F.transform(all_rows, lambda r: r["empty"]), "")
        whole = let(body, lambda text: F.array(chunk(F.lit("content"), F.lit("content"), trim_long(text))))
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    pages = sections.groupBy(*keys).agg(rows.alias("rows"))
    return explode_chunks(pages, id_col, let(F.col("rows"), chunks))


def html_section_markdown(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The sections with their content as Markdown."""
    sections = html_sections(df, id_col, html_col)
    keys = [id_col, "chunk_index", "key", "title"]
    return html_to_markdown(sections, keys, "content", distribute=False).withColumnRenamed("markdown", "content")
