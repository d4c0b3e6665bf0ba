"""HTML text: clean-up, tags, attributes, entities, Markdown escaping.

The functions take and return Spark SQL expressions as text: they are used several times in one plan, and one
parsed expression is much cheaper to build than its hundreds of nodes one by one.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# One tag, a stretch of text, or a lone "<". Quotes count only after "=", so a stray one ends nothing.
ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
TOKEN = rf"</?[a-zA-Z]{ATTRIBUTES}(?:>|\z)|[^<]++|<"
# Comments, declarations, invisible elements, the html and body tags, and a tag cut off by the end of the page.
NOISE = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|[!?][^>]*+>"
    r"|head(?:[\s/][^>]*+)?>.*?</head\s*+>"
    r"|script(?:[\s/][^>]*+)?>.*?(?:</script[^>]*+>|\z)"
    r"|style(?:[\s/][^>]*+)?>.*?(?:</style[^>]*+>|\z)"
    r"|title(?:[\s/][^>]*+)?>.*?(?:</title[^>]*+>|\z)"
    rf"|/?(?:html|head|body)(?:[\s/]{ATTRIBUTES})?>"
    r"|/?[a-z][^<>]*+\z)"
)
# Characters that mark up fragments while a block is put together (see operators.html).
MARKS = "\x01\x02\x03\x04\x05\x06\x07\x0b\x0e\x0f"
# Stands before a letter that means a character of the page that is one of these.
HIDDEN = "\x10"
LETTERS = "".join(chr(ord(char) + 64) for char in HIDDEN + MARKS)

VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK_TAGS = (
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table caption tbody td tfoot th thead tr ul"
).split()
# Elements whose headings are not headings of the page: they are not children of the body.
CONTAINER_TAGS = (
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form header hgroup "
    "main menu nav noscript ol search section select table ul"
).split()
STRONG_TAGS = ["strong", "b"]
EMPHASIS_TAGS = ["em", "i"]

# Named entities. Those of the first two tables are also known without the semicolon.
MARKUP_ENTITIES = {"amp": "&", "quot": '"', "lt": "<", "gt": ">"}
# Names of the characters U+00A0 to U+00FF, in order.
LATIN1_ENTITIES = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute "
    "micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest Agrave Aacute Acirc Atilde Auml Aring "
    "AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml "
    "times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc atilde auml aring aelig ccedil "
    "egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash "
    "ugrave uacute ucirc uuml yacute thorn yuml"
).split()
OTHER_ENTITIES = {
    "apos": "'", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "sbquo": "\u201a",
    "ldquo": "\u201c", "rdquo": "\u201d", "bdquo": "\u201e", "bull": "\u2022", "hellip": "\u2026",
    "lsaquo": "\u2039", "rsaquo": "\u203a", "euro": "\u20ac", "trade": "\u2122", "larr": "\u2190",
    "uarr": "\u2191", "rarr": "\u2192", "darr": "\u2193", "minus": "\u2212", "infin": "\u221e", "ne": "\u2260",
    "le": "\u2264", "ge": "\u2265", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "zwnj": "\u200c",
    "zwj": "\u200d", "OElig": "\u0152", "oelig": "\u0153", "Scaron": "\u0160", "scaron": "\u0161",
    "dagger": "\u2020", "permil": "\u2030", "sdot": "\u22c5",
}
# Numeric references 128 to 159 mean these Windows characters.
WINDOWS_CODES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
WINDOWS_CHARS = "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"

ENTITY = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+);?|[^&]++|&"


def entity_table() -> dict[str, str]:
    """Reference text without the ampersand -> character, frequent ones first."""
    bare = {**MARKUP_ENTITIES, **{name: chr(0xA0 + i) for i, name in enumerate(LATIN1_ENTITIES)}}
    table = {f"{name};": char for name, char in {**bare, **OTHER_ENTITIES}.items()}
    table.update(bare)
    # All names of the HTML standard.
    return table | {name: char for name, char in html5.items() if name not in table}


def quote(text: str) -> str:
    """Raw SQL string literal; an apostrophe is written as in a regular expression."""
    return "r'" + text.replace("'", r"\x27") + "'"


def bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once as ``name`` within ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def decode_entities(text: str) -> str:
    """Replace character references in one pass; unknown ones stay as they are. ``text`` should be a plain column."""
    # Folded into one constant when the plan is optimized.
    entries = "\x02".join(f"{name}\x01{char}" for name, char in entity_table().items()).replace("\\", "\\\\").replace("'", "\\'")
    table = f"str_to_map('{entries}', '\x02', '\x01')"
    # More than eight digits, leading zeros aside, are no character, and could overflow.
    base = "CASE WHEN p RLIKE '^&#[xX]' THEN 16 ELSE 10 END"
    number = f"CASE WHEN length(d) <= 8 THEN CAST(conv(d, {base}, 10) AS BIGINT) END"
    code = bind("regexp_replace(p, '^&#[xX]?0*|;', '')", "d", number)
    # What is no character becomes U+FFFD.
    safe = "CASE WHEN c BETWEEN 1 AND 1114111 AND NOT c BETWEEN 55296 AND 57343 THEN CAST(c AS INT) ELSE 65533 END"
    char = f"decode(unhex(lpad(hex({safe}), 8, '0')), 'UTF-32')"
    numeric = bind(code, "c", f"translate({char}, '{WINDOWS_CODES}', '{WINDOWS_CHARS}')")
    piece = (
        f"CASE WHEN NOT startswith(p, '&') THEN p WHEN startswith(p, '&#') THEN "
        f"CASE WHEN p RLIKE '[0-9a-fA-F]' THEN {numeric} ELSE p END "
        f"ELSE coalesce({table}[substr(p, 2)], p) END"
    )
    pieces = f"regexp_extract_all({text}, {quote(ENTITY)}, 0)"
    return f"CASE WHEN contains({text}, '&') THEN array_join(transform({pieces}, p -> {piece}), '') ELSE {text} END"


def clean_html(html: str) -> str:
    """The content of the body, without comments and invisible elements."""
    return f"regexp_replace({html}, {quote(NOISE)}, '')"


def has(text: str, *parts: str) -> str:
    """Whether one of the parts occurs; far cheaper than a pattern that looks for them."""
    return "(" + " OR ".join(f"contains({text}, '{part}')" for part in parts) + ")"


def hide_marks(text: str) -> str:
    """Text in which none of the MARKS occurs; see shown_marks."""
    hidden = HIDDEN + MARKS
    # One pass finds them all: a replacement of each would go through the whole text every time.
    pieces = f"regexp_extract_all(h, '[{hidden}]|[^{hidden}]++', 0)"
    piece = f"CASE WHEN contains('{hidden}', substr(c, 1, 1)) THEN concat('{HIDDEN}', translate(c, '{hidden}', '{LETTERS}')) ELSE c END"
    return bind(text, "h", f"CASE WHEN h RLIKE '[{hidden}]' THEN array_join(transform({pieces}, c -> {piece}), '') ELSE h END")


def shown_marks(text: Column) -> Column:
    """The characters that hide_marks hid, in their places. ``text`` should be a plain column."""
    pieces = F.regexp_extract_all(text, F.lit(f"{HIDDEN}[{LETTERS}]|[^{HIDDEN}]++|{HIDDEN}"), F.lit(0))
    shown = F.transform(
        pieces,
        lambda p: F.when(
            F.startswith(p, F.lit(HIDDEN)) & (p != HIDDEN), F.translate(F.substring(p, 2, 1), LETTERS, HIDDEN + MARKS)
        ).otherwise(p),
    )
    return F.when(F.contains(text, F.lit(HIDDEN)), F.array_join(shown, "")).otherwise(text)


def html_tokens(body: str) -> str:
    return f"regexp_extract_all({body}, {quote(TOKEN)}, 0)"


def tag_name(token: str) -> str:
    """Lower-case tag name, null for text."""
    name = rf"lower(regexp_extract({token}, r'^</?([a-zA-Z][^\s/>]*+)', 1))"
    return f"CASE WHEN startswith({token}, '<') AND {token} <> '<' THEN {name} END"


def one_of(tag: str, names: list[str]) -> str:
    return f"coalesce({tag} IN ({', '.join(repr(n) for n in names)}), false)"


def either(tag: str, names: list[str]) -> str:
    """As one_of for a condition of few names; null counts as false there. Equality needs no generated code to be fast."""
    return "(" + " OR ".join(f"{tag} = '{name}'" for name in names) + ")"


def tag_kind(token: str, tag: str) -> str:
    """text, open, close or void."""
    return (
        f"CASE WHEN {tag} IS NULL THEN 'text' WHEN {one_of(tag, VOID_TAGS)} THEN 'void' "
        f"WHEN startswith({token}, '</') THEN 'close' ELSE 'open' END"
    )


def attribute(token: str, name: str) -> str:
    """Decoded value of an attribute, '' if it is absent."""
    raw = quote(rf"""(?is)\s{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
    bare = f"""regexp_replace(regexp_extract({token}, {raw}, 1), {quote("""^["']|["']$""")}, '')"""
    return bind(bare, "a", decode_entities("a"))


def collapse_space(text: str) -> str:
    run = "regexp_replace(w, r'[ \t\r\n]{2,}|[\t\r\n]', ' ')"
    return bind(text, "w", f"CASE WHEN {has('w', '  ', chr(9), chr(13), chr(10))} THEN {run} ELSE w END")


def decoded_text(token: str) -> str:
    """Text of a text token: white space collapsed, then entities decoded."""
    return bind(collapse_space(token), "t", decode_entities("t"))


def escape_markdown(text: str, starts_block: str) -> str:
    """Escape what Markdown would read as markup; some marks count only where a text starts."""
    inline = rf"regexp_replace({text}, r'[\\*`\[\]_]', r'\\$0')"
    start = f"CASE WHEN {starts_block} THEN ltrim(i) ELSE i END"
    marks = rf"regexp_replace(s, r'^(-|\+ |=+|#{{1,6}} |~~~|>)', r'\\$1')"
    number = rf"regexp_replace({marks}, r'^(\d+)\. ', r'$1\\. ')"
    # Few texts start with one of these.
    rare = f"CASE WHEN substr(s, 1, 1) IN ('-', '+', '=', '#', '~', '>') OR substr(s, 1, 1) BETWEEN '0' AND '9' THEN {number} ELSE s END"
    return bind(inline, "i", bind(start, "s", rare))
