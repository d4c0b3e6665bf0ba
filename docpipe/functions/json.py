"""JSON text inside its row: tokens, their classes, validity, indentation, members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.functions.arrays import let, running_sums

OPENERS = ["{", "["]
CLOSERS = ["}", "]"]

# String, punctuation, bare word, or a quote that never closes.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^ \t\r\n{}\[\]:,"]++|"'
STRING = r'^"(?:[^"\\\x00-\x1F]++|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"\z'
SCALAR = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)\z"


def json_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_class(token: Column) -> Column:
    """The punctuation itself, or s (string), v (other scalar), x (not JSON)."""
    return (
        F.when(token.isin("{", "}", "[", "]", ",", ":"), token)
        .when(F.startswith(token, F.lit('"')), F.when(token.rlike(STRING), "s").otherwise("x"))
        .when(token.rlike(SCALAR), "v")
        .otherwise("x")
    )


def string_value(token: Column) -> Column:
    """Text of a string token."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    escaped = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    return F.when(F.contains(token, F.lit("\\")), escaped).otherwise(plain)


# Classes of the tokens of a container that holds no other, and of a text of one such value.
INNERMOST = r"\{(?:s:[sv](?:,s:[sv])*+)?+\}|\[(?:[sv](?:,[sv])*+)?+\]"
FLAT = rf"^(?:[sv]|{INNERMOST})\z"
# So many levels of containers are taken away from inside; what is deeper still is sorted by level.
ROUNDS = 32
# A class that may not stand before the next one, whatever the depth; a comma is followed by a key or a value.
MISPLACED = (
    r"x|\{(?!\}|s:)|\[(?!\]|[v{\[]|s(?!:))|,(?![sv{\[])|:(?![v{\[]|s(?!:))|(?<![{,]s):|s(?![:,}\]]|\z)|[v}\]](?![,}\]]|\z)"
)
# Containers of one level one after the other: commas of objects stand before keys, those of arrays before items.
NESTED = r"^(?:15*+2|36*+4)*+\z"


def _depths(classes: Column) -> Column:
    """How many containers are open after each token."""
    return running_sums(F.transform(classes, lambda c: F.when(c.isin(OPENERS), 1).when(c.isin(CLOSERS), -1).otherwise(0)))


def _is_nested(classes: Column) -> Column:
    """Whether all containers are closed by their own bracket and parted by the right commas: brackets and commas are
    sorted by the depth inside their container, which puts those of one container side by side."""

    def code(c: Column, i: Column) -> Column:
        key = (F.get(classes, i + 1) == "s") & F.coalesce(F.get(classes, i + 2) == ":", F.lit(False))
        return F.when(c == "{", 1).when(c == "}", 2).when(c == "[", 3).when(c == "]", 4).when(c == ",", F.when(key, 5).otherwise(6))

    def place(depths: Column) -> Column:
        # Level, position and code in one number.
        level = lambda c, i: (F.get(depths, i) + F.when(c.isin(CLOSERS), 1).otherwise(0)).cast("long")
        return F.transform(classes, lambda c, i: level(c, i) * (1 << 34) + i.cast("long") * 8 + code(c, i))

    placed = F.sort_array(F.filter(let(_depths(classes), place), lambda p: p.isNotNull()))
    return F.array_join(F.transform(placed, lambda p: F.pmod(p, F.lit(8)).cast("string")), "").rlike(NESTED)


def _is_valid(classes: Column) -> Column:
    """Strict validity by the classes of all tokens."""

    def shorter(a: Column, _: Column) -> Column:
        taken = let(F.regexp_replace(a["rest"], INNERMOST, "v"), lambda r: F.struct(r.alias("rest"), (F.length(r) < F.length(a["rest"])).alias("more")))
        return F.when(a["more"], taken).otherwise(a)

    def by_rounds(line: Column) -> Column:
        start = F.struct(line.alias("rest"), F.lit(True).alias("more"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, shorter)

    def deep(line: Column) -> Column:
        return F.when(line.rlike(MISPLACED), False).otherwise(_is_nested(classes))

    def checked(line: Column) -> Column:
        rounds = let(by_rounds(line), lambda a: F.when(a["rest"].rlike(FLAT), True).when(~a["more"], False).otherwise(deep(line)))
        return F.when(line.rlike(FLAT), True).otherwise(rounds)

    return let(F.array_join(classes, ""), checked)


def _fragments(tokens: Column, classes: Column, depths: Column, outside: int) -> Column:
    """Tokens with the line break and indentation before them; containers up to the depth ``outside`` do not count, and
    the first token of what is inside them stays on its line."""

    def fragment(token: Column, i: Column) -> Column:
        cls, before, depth = F.get(classes, i), F.get(classes, i - 1), F.get(depths, i) - outside

        def indented(level: Column) -> Column:
            return F.concat(F.lit("\n"), F.repeat(F.lit("  "), level), token)

        level = depth - F.when(cls.isin(OPENERS), 1).otherwise(0)
        return (
            F.when(cls.isin(CLOSERS), F.when(before.isin(OPENERS), token).otherwise(indented(depth)))
            .when(cls == ",", token)
            .when(cls == ":", ": ")
            .when(before.isin("{", "[", ",") & (level > 0), indented(level))
            .otherwise(token)
        )

    return F.transform(tokens, fragment)


def _of_valid(text: Column, body: Callable[[Column, Column], Column], otherwise: Column | None = None) -> Column:
    """``body`` of tokens and classes where the text is valid."""

    def read(tokens: Column) -> Column:
        return let(F.transform(tokens, token_class), lambda classes: F.when(_is_valid(classes), body(tokens, classes)).otherwise(otherwise))

    return let(F.coalesce(json_tokens(text), F.array().cast("array<string>")), read)


def valid(text: Column) -> Column:
    """Strict validity; a null or empty text is not valid."""
    return _of_valid(text, lambda tokens, classes: F.lit(True), F.lit(False))


def pretty(text: Column) -> Column:
    """Text indented by two spaces; null where it is not valid JSON."""

    def joined(tokens: Column, classes: Column) -> Column:
        return F.array_join(let(_depths(classes), lambda depths: _fragments(tokens, classes, depths, 0)), "")

    return _of_valid(text, joined)


def members(text: Column) -> Column:
    """(kind, name, content) of every member of an object, item of an array, or of the scalar; null if not valid."""

    def member(kind: Column, name: Column, content: Column) -> Column:
        return F.struct(kind.alias("kind"), name.alias("name"), content.alias("content"))

    def cut(tokens: Column, classes: Column) -> Column:
        root = F.element_at(classes, 1)
        kind = F.when(root == "{", "object").when(root == "[", "array").otherwise("scalar")

        def between(depths: Column, fragments: Column) -> Column:
            commas = F.filter(
                F.transform(classes, lambda c, i: F.when((c == ",") & (F.get(depths, i) == 1), i + 1)), lambda i: i.isNotNull()
            )
            # Positions, counted from one, of what stands before and behind the members.
            bounds = F.concat(F.array(F.lit(1)), commas, F.array(F.size(tokens)))

            def parts(at: Column) -> Column:
                def part(start: Column, i: Column) -> Column:
                    first = start + F.when(root == "{", 3).otherwise(1)
                    content = F.array_join(F.slice(fragments, first, F.get(at, i + 1) - first), "")
                    return member(kind, F.when(root == "{", string_value(F.element_at(tokens, start + 1))), content)

                return F.transform(F.slice(at, 1, F.size(at) - 1), part)

            return let(bounds, parts)

        inside = let(_depths(classes), lambda depths: let(_fragments(tokens, classes, depths, 1), lambda f: between(depths, f)))
        return (
            F.when(kind == "scalar", F.array(member(kind, F.lit(None).cast("string"), F.element_at(tokens, 1))))
            .when(F.size(tokens) > 2, inside)
        )

    return _of_valid(text, cut)
