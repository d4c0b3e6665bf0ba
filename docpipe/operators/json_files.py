"""JSON documents that are files of any size: one row per item of an array, member of an object, or scalar.

A file is read as pieces between commas, and runs of pieces are put into one row. Whether a run starts inside a string
is the number of quotes before it, and how deep it starts is the sum of the brackets outside strings before it; both are
sums over runs, so that a file is scanned by many tasks. Commas at depth one part the items inside each run; only items
that a run breaks off are gathered. They are then checked one by one: no row holds more than an item or a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.functions.arrays import let, running_sums
from docpipe.functions.text import decode_utf8
from docpipe.operators.json_tokens import split_json
from docpipe.sources.pieces import BLOCK, BOM, FILE, PLACE, file_totals, gathered, read_pieces, runs_of_pieces, with_sums_before

BLANKS = " \t\r\n"
# A string may go on behind the text.
STRING = r'"(?:[^"\\]++|\\.)*+(?:"|\z)'
# Up to the next comma outside strings.
SEGMENT = rf'(?s)(?:[^",]++|{STRING})++,?+|,'


def _count(text: Column, marks: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.translate(text, marks, ""))


def _quotes(text: Column) -> Column:
    return _count(F.regexp_replace(text, r"(?s)\\.", ""), '"')


def _delta(text: Column) -> Column:
    """How many more containers are open behind the text than before it."""
    outside = F.regexp_replace(text, f"(?s){STRING}", "")
    return let(outside, lambda o: F.octet_length(F.translate(o, "}]", "")) - F.octet_length(F.translate(o, "{[", "")))


def _sums_before(runs: DataFrame, name: str, amount: Column) -> DataFrame:
    """(file, block, place, amount, name): the sum over the runs of the file before; texts are left behind."""
    amounts = runs.select(FILE, BLOCK, PLACE, amount.alias("amount")).repartition(FILE, BLOCK)
    return with_sums_before(amounts, {name: F.col("amount")})


def _items_of_run(text: Column, depth: Column, quoted: Column) -> Column:
    """(text, used, single) of the items of a run: the first goes on from the run before, the last into the next one.

    The text ends with a comma; where it starts inside a string, a quote stands before it.
    """
    closes = _quotes(text) % 2 == 0

    def cut(segments: Column) -> Column:
        def at_depths(depths: Column) -> Column:
            ends = F.transform(depths, lambda d, i: F.when((d + depth == 1) & ((i < F.size(segments) - 1) | closes), i + 1))
            return let(F.concat(F.array(F.lit(0)), F.filter(ends, lambda e: e.isNotNull())), between)

        def between(bounds: Column) -> Column:
            def item(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(bounds, k + 1), F.size(segments))
                skipped = F.when((k == 0) & (quoted % 2 == 1), 1).otherwise(0)
                whole = F.array_join(F.slice(segments, start + 1, end - start), "")
                inner = let(whole, lambda w: F.substr(w, skipped + 1, F.length(w) - skipped - 1))
                return F.struct(inner.alias("text"), (end > start).alias("used"), ((k > 0) & (k < F.size(bounds) - 1)).alias("single"))

            return F.transform(bounds, item)

        return let(running_sums(F.transform(segments, _delta)), at_depths)

    return let(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)), cut)


def json_file_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items (file, partition columns, item, text) without the brackets of the document, not yet checked, and the
    documents (file, partition columns, root, n_items, sound): sound ones have a bracket at either end, or none.

    Tables with a row per file are broadcast: the driver has listed the files.
    """
    pieces = read_pieces(spark, path, ",")
    parts = [c for c in pieces.columns if c not in (FILE, BLOCK, PLACE, "piece", "file_bytes")]
    place = [FILE, BLOCK, PLACE]
    runs = runs_of_pieces(pieces, ",")
    text = F.concat(decode_utf8(F.col("piece").cast("binary")), F.lit(","))
    texts = runs.select(*place, *parts, text.alias("text"))
    texts = texts.join(_sums_before(texts, "quoted", _quotes(F.col("text"))).drop("amount"), place)
    texts = texts.withColumn("text", F.concat(F.when(F.col("quoted") % 2 == 1, '"').otherwise(""), "text"))
    texts = texts.join(_sums_before(texts, "depth", _delta(F.col("text"))).drop("amount"), place)
    # The exchange is the same for all that reads the items, so that they are cut once; with the keys in the order of
    # the join it would be left out.
    cut = texts.select(*place, *parts, _items_of_run(F.col("text"), F.col("depth"), F.col("quoted")).alias("items"))
    numbers = _sums_before(cut, "item", F.size("items") - 1)
    rows = cut.repartition(*reversed(place)).join(numbers.drop("amount"), place).select(*place, *parts, "item", F.posexplode("items").alias("k", "i"))
    rows = rows.filter("i.used").select(
        FILE, *parts, (F.col("item") + F.col("k")).alias("item"), F.col("i.single").alias("single"), BLOCK, PLACE, F.col("i.text").alias("piece")
    )
    items = gathered(rows, [FILE, *parts, "item"], ",")

    last = numbers.groupBy(FILE).agg(F.max(F.col("item") + F.col("amount")).alias("last"))
    # An item that ends with the file is not counted as one; after a last comma there is none.
    ends = file_totals(runs).join(last, FILE).select(FILE, "closed", "bom", "last")
    edges = items.join(F.broadcast(ends), FILE)
    text = F.when(F.col("bom") & (F.col("item") == 0), F.concat(F.lit(BOM), "text")).otherwise(F.col("text"))
    edges = edges.withColumn("text", F.trim(text, F.lit(BLANKS)))
    first, final = F.col("item") == 0, F.col("item") == F.col("last")
    opener, closer = F.max(F.when(first, F.substring("text", 1, 1))), F.max(F.when(final, F.substring("text", -1, 1)))
    sizes = F.max(F.when(first & final, F.length("text")))
    documents = edges.filter(first | final).groupBy(FILE, *parts).agg(
        opener.alias("o"), closer.alias("c"), F.max(F.col("last") + 1).alias("n_items"), F.max("closed").alias("closed"), sizes.alias("size")
    )
    closed_by = F.when(F.col("o") == "{", "}").when(F.col("o") == "[", "]")
    root = F.when(closed_by.isNull(), "scalar").when(F.col("o") == "{", "object").otherwise("array")
    sound = ~F.col("closed") & F.when(closed_by.isNull(), F.col("n_items") == 1).otherwise(
        (F.col("c") == closed_by) & F.coalesce(F.col("size") > 1, F.lit(True))
    )
    documents = documents.select(FILE, *parts, root.alias("root"), "n_items", F.coalesce(sound, F.lit(False)).alias("sound"))
    edges = edges.select(FILE, *parts, "item", "text", "last").join(
        F.broadcast(documents.filter("sound").select(FILE, "root", "n_items")), FILE
    )
    cut = F.when((F.col("root") != "scalar") & first, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    edges = edges.withColumn("text", cut)
    cut = F.when((F.col("root") != "scalar") & final, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return edges.withColumn("text", F.trim(cut, F.lit(BLANKS))).drop("last"), documents


def split_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, partition columns, chunk_index, key, title, content) of all valid documents: what `split_json` gives for
    the whole text. A document with a single wrong item gives nothing."""
    items, documents = json_file_items(spark, path)
    parts = [c for c in items.columns if c not in (FILE, "item", "text", "root", "n_items")]
    empty = (F.col("n_items") == 1) & (F.col("text") == "") & (F.col("root") != "scalar")
    text = F.when(F.col("root") == "object", F.concat(F.lit("{"), "text", F.lit("}"))).when(
        F.col("root") == "array", F.concat(F.lit("["), "text", F.lit("]"))
    )
    id_ = F.struct(FILE, *parts, F.col("item").cast("int").alias("item"), "root", "n_items").alias("id")
    given = items.filter(~empty).select(id_, F.coalesce(text, F.col("text")).alias("json"))
    chunks = split_json(given, "id", "json", distribute=False).filter(F.col("chunk_index") == 0)
    chunks = chunks.select("id.*", "key", "title", "content")
    whole = chunks.groupBy(FILE).agg(F.count("*").alias("n"), F.max("n_items").alias("n_items")).filter("n = n_items").select(FILE)
    index, array = F.col("item").cast("string"), F.col("root") == "array"
    return chunks.join(F.broadcast(whole), FILE).select(
        FILE,
        *parts,
        F.col("item").alias("chunk_index"),
        F.when(array, F.concat(F.lit("item_"), index)).otherwise(F.col("key")).alias("key"),
        F.when(array, F.concat(F.lit("["), index, F.lit("]"))).otherwise(F.col("title")).alias("title"),
        "content",
    )
