"""JSON documents: validity, indentation, split by member.

Tokens, numbers and keys keep their text and order; nothing is parsed into values and written back. A document is read
inside its row by array expressions, so that nothing is sorted and a task holds one document at a time; one exchange
spreads the documents, whose size is bounded by the response size limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.functions import json as J


def _spread(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Documents dealt by id and text, so that a repeated or missing id does not gather others in one task."""
    return df.select(id_col, json_col).repartition(F.col(id_col), F.xxhash64(json_col))


def json_valid(df: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Strict validity of every text; a null or empty one is not valid."""
    return _spread(df, id_col, json_col).select(id_col, J.valid(F.col(json_col)).alias("valid"))


def json_pretty(df: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Text indented by two spaces; null where the text is not valid JSON."""
    pretty = _spread(df, id_col, json_col).select(id_col, J.pretty(F.col(json_col)).alias("pretty"))
    return pretty.select(id_col, F.col("pretty").isNotNull().alias("valid"), "pretty")


def split_json(
    df: DataFrame,
    id_col: str = "doc_id",
    json_col: str = "json",
    roots: Sequence[str] = ("object", "array", "scalar"),
    distribute: bool = True,
) -> DataFrame:
    """One chunk per member of an object, item of an array, or scalar; none for invalid texts.

    ``distribute=False`` is for input that is spread already.
    """
    docs = _spread(df, id_col, json_col) if distribute else df.select(id_col, json_col)
    kind, name, index = F.col("m.kind"), F.col("m.name"), F.col("chunk_index").cast("string")

    def named(before: str, after: str) -> Column:
        return F.when(kind == "object", name).when(kind == "array", F.concat(F.lit(before), index, F.lit(after))).otherwise("value")

    members = docs.select(id_col, F.posexplode(J.members(F.col(json_col))).alias("chunk_index", "m")).filter(kind.isin(*roots))
    return members.select(id_col, "chunk_index", named("item_", "").alias("key"), named("[", "]").alias("title"), F.col("m.content").alias("content"))
