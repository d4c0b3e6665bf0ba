"""CSV text held in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import CSV_GROUP_ROWS, CSV_INLINE_ROWS
from docpipe.functions.arrays import let
from docpipe.functions.text import chunk

# A quote opens a quoted stretch anywhere in a field; two quotes inside it stand for one.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"?'
RECORD = rf'((?:{QUOTED}|[^"\n]++)*+)\n'
FIELD = rf'((?:{QUOTED}|[^",]++)*+),'
PIECE = rf'{QUOTED}|[^"]++'


def _closed(text: Column) -> Column:
    """Close a quote that is still open at the end, which changes no field."""
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    return F.when(quotes % 2 == 1, F.concat(text, F.lit('"'))).otherwise(text)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def csv_records(text: Column) -> Column:
    """Array of raw records; the last one is what follows the final line break, maybe nothing."""
    quoted = _all(F.concat(_closed(text), F.lit("\n")), RECORD, 1)
    return F.when(F.contains(text, F.lit('"')), quoted).otherwise(F.split(text, "\n", -1))


def _unquote(field: Column) -> Column:
    def piece(p: Column) -> Column:
        return F.when(
            F.startswith(p, F.lit('"')),
            F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(F.replace(p, F.lit("\r"), F.lit("")))

    return F.when(F.contains(field, F.lit('"')), F.array_join(F.transform(_all(field, PIECE, 0), piece), "")).otherwise(
        F.replace(field, F.lit("\r"), F.lit(""))
    )


def csv_fields(record: Column) -> Column:
    """Array of the field values of one record."""
    quoted = F.transform(_all(F.concat(_closed(record), F.lit(",")), FIELD, 1), _unquote)
    plain = F.split(F.replace(record, F.lit("\r"), F.lit("")), ",", -1)
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(plain)


def is_phantom(fields: Column) -> Column:
    """Whether the last record is nothing but the end of the text."""
    return (F.size(fields) == 1) & (F.get(fields, F.lit(0)) == "")


def csv_rows(text: Column) -> Column:
    """Array of rows, each an array of field values."""
    return let(
        F.transform(csv_records(text), csv_fields),
        lambda rows: F.when(is_phantom(F.element_at(rows, -1)), F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(
            rows
        ),
    )


def csv_width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def row_line(cells: Column, width: Column) -> Column:
    """A row of the Markdown table, filled up to the width."""
    return _line(F.concat(cells, F.array_repeat(F.lit(""), width - F.size(cells))))


def divider(header: Column) -> Column:
    """The divider is as wide as the header itself."""
    return _line(F.transform(header, lambda _: F.lit("---")))


def _head(rows: Column, width: Column) -> Column:
    header = F.get(rows, F.lit(0))
    return F.array(row_line(header, width), divider(header))


def markdown_table(rows: Column) -> Column:
    """Markdown table of a rows array, the first row being the header."""
    return let(
        rows,
        lambda r: F.when(F.size(r) == 0, "").otherwise(
            let(
                csv_width(r),
                lambda width: F.array_join(
                    F.concat(
                        _head(r, width),
                        F.transform(F.slice(r, F.lit(2), F.size(r) - 1), lambda cells: row_line(cells, width)),
                    ),
                    "\n",
                ),
            )
        ),
    )


def row_groups(rows: Column, inline_rows: int = CSV_INLINE_ROWS, group_rows: int = CSV_GROUP_ROWS) -> Column:
    """Array of (key, title, content), one per group of data rows, the header repeated; empty if short."""

    def groups(r: Column) -> Column:
        return let(csv_width(r), lambda width: let(_head(r, width), lambda head: cut(r, width, head)))

    def cut(r: Column, width: Column, head: Column) -> Column:
        last = F.size(r) - 1
        return F.transform(
            F.sequence(F.lit(1), last, F.lit(group_rows)),
            lambda start: let(
                F.least(start + (group_rows - 1), last),
                lambda end: chunk(
                    F.concat_ws("_", F.lit("rows"), start.cast("string"), end.cast("string")),
                    F.concat(F.lit("rows "), start.cast("string"), F.lit("-"), end.cast("string")),
                    F.array_join(
                        F.concat(
                            head,
                            F.transform(
                                F.slice(r, start + 1, end - start + 1), lambda cells: row_line(cells, width)
                            ),
                        ),
                        "\n",
                    ),
                ),
            ),
        )

    return let(rows, lambda r: F.when(F.size(r) > inline_rows, groups(r)))
