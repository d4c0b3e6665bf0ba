"""Inputs of the queries, derived by Spark from the given tables.

Where rows are put together to a document, the key holds a block of a unique id, which bounds the size of every
document however skewed the other part of the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.functions.arrays import ordered_concat
from docpipe.functions.text import slug

AS_OF = "2024-01-31 12:00:00"
DOCS_PER_BLOCK = 500
ROWS_PER_BLOCK = 2_000
EVENTS_PER_BLOCK = 10_000
TURNS_PER_BLOCK = 100


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url", "html")


def responses_of(pages: DataFrame) -> DataFrame:
    """Pages as responses; every tenth is an error, some declared lengths are wrong or no number."""
    length = F.octet_length("html").cast("string")
    return pages.select(
        "page_id",
        "url",
        F.when(F.col("page_id") % 10 == 9, 404).otherwise(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.when(F.col("page_id") % 13 == 0, "999999999")
        .when(F.col("page_id") % 13 == 1, "n/a")
        .otherwise(length)
        .alias("content_length"),
        F.encode("html", "UTF-8").alias("body"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(page_id AS INT), 0)")
        .cast("timestamp")
        .alias("fetched_at"),
    )


def responses_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses_of(pages(spark, sf_dir))


HEADERS = [
    "Text/HTML; charset=utf-8", "application/json", "application/pdf", "text/csv", "application/gzip",
    "application/octet-stream", "text/plain", "image/png", "", None,
]
SUFFIXES = [".pdf", ".csv?x=1", ".tgz#f", ".json", ".htm", "", ".zip"]


def responses_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all kinds of headers and URL extensions."""
    header, suffix = F.lit(None).cast("string"), F.lit("")
    for i, text in enumerate(HEADERS):
        header = F.when(F.col("page_id") % 10 == i, F.lit(text).cast("string")).otherwise(header)
    for i, text in enumerate(SUFFIXES):
        suffix = F.when(F.col("page_id") % 7 == i, text).otherwise(suffix)
    return (
        responses_html(spark, sf_dir)
        .withColumns({"content_type": header, "url": F.concat("url", suffix), "status": F.lit(200)})
        .withColumn("content_length", F.lit(None).cast("string"))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


def responses_of_documents(docs: DataFrame) -> DataFrame:
    """Four responses per document: its text, the same as an image, a page and an object about it; some fail."""
    n = F.col("doc_id")
    name = F.concat(F.lit("https://example.org/"), n.cast("string"))
    about = F.concat(F.lit('{"id": '), n.cast("string"), F.lit(', "source": "'), "source", F.lit('"}'))
    page = F.concat(F.lit("<h1>"), "source", F.lit("</h1><p>"), n.cast("string"), F.lit("</p>"))

    def response(suffix, content_type, body):
        return F.struct(
            F.concat(name, F.lit(suffix)).alias("url"), F.lit(content_type).alias("content_type"), F.encode(body, "UTF-8").alias("body")
        )

    kinds = F.array(
        response(".txt", "text/plain", F.col("text")),
        response(".png", "image/png", F.col("text")),
        response(".html", "text/html", page),
        response(".json", "application/json", F.when(n % 7 == 0, F.concat(about, F.lit(","))).otherwise(about)),
    )
    return docs.select("doc_id", F.explode(kinds).alias("r")).select(
        "r.*",
        F.when(n % 10 == 9, 500).otherwise(200).alias("status"),
        F.when(n % 13 == 1, "999999999").alias("content_length"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)").cast("timestamp").alias("fetched_at"),
    )


def _escaped(text):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html_nested_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document inside one to eight marks of one kind, with too many closing tags, marks left open,
    empty marks and control characters."""
    doc = F.col("doc_id")
    # The class of ASCII letters and digits by its name: written as ranges, its negation takes Java many times as long.
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{Alnum}+", " "))
    depth = doc % 8 + 1
    html = F.concat(
        F.lit("<p>x"), F.repeat(F.lit("<b>"), depth), F.lit("a\x02 "), words, F.lit(" \x10B"), F.repeat(F.lit("</b>"), depth + doc % 3),
        F.lit("</i>"), F.repeat(F.lit("<em>"), depth), F.repeat(F.lit("</em>"), depth), F.lit("&#1; "), F.repeat(F.lit("<i>"), doc % 6), F.lit("e</p><p>n</i>d</p>"),
    )
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", html.alias("html"))


def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pages with a headed section per document."""
    section = F.concat(
        F.lit("<h2>"), "source", F.lit(" doc "), F.col("doc_id").cast("string"), F.lit("</h2><p>"),
        _escaped(F.col("text")), F.lit("</p>"),
    )
    return (
        documents(spark, sf_dir)
        .groupBy("source", F.expr(f"doc_id div {DOCS_PER_BLOCK}").alias("block"))
        .agg(ordered_concat(F.col("doc_id"), section).alias("html"))
        .select(F.concat_ws("/", "source", "block").alias("article_id"), "html")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.col("props").alias("json"))


def json_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, some of them damaged in different ways."""
    k = F.col("event_id") % 12
    props = F.col("props")
    damaged = (
        F.when(k == 1, F.concat(props, F.lit(" x")))
        .when(k == 2, F.concat(props, F.lit(",")))
        .when(k == 3, F.concat(F.lit("["), props, F.lit(",]")))
        .when(k == 4, F.replace(props, F.lit('"'), F.lit("'")))
        .when(k == 5, F.concat(F.lit("["), props, F.lit(",01]")))
        .when(k == 6, F.concat(F.lit("["), props, F.lit("}")))
        .when(k == 7, F.replace(props, F.lit(":"), F.lit(",")))
        .when(k == 8, F.concat(F.lit("["), props, F.lit(", null, -1.5e3]")))
        .otherwise(props)
    )
    return events(spark, sf_dir).select("event_id", damaged.alias("json"))


def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar documents: strings, numbers, literals."""
    k = F.col("event_id") % 4
    value = (
        F.when(k == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))
        .when(k == 1, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
        .when(k == 2, "true")
        .otherwise("null")
    )
    return events(spark, sf_dir).select("event_id", value.alias("json"))


def json_event_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "user": '), F.col("user_id").cast("string"),
        F.lit(', "type": "'), "event_type", F.lit('", "props": '), "props", F.lit("}"),
    )
    return (
        events(spark, sf_dir)
        .groupBy("event_type", F.expr(f"event_id div {EVENTS_PER_BLOCK}").alias("block"))
        .agg(ordered_concat(F.col("event_id"), item, ", ").alias("items"))
        .select(
            F.concat_ws("/", "event_type", "block").alias("doc_id"),
            F.concat(F.lit("["), "items", F.lit("]")).alias("json"),
        )
    )


ROWS_PER_FILE = 1_000_000


def _as_files(rows: DataFrame, order: str, line: Column, path: str) -> str:
    """Files of many lines, one per block of a unique id; `line` may use `first` and `last`. Each is written by a task
    that streams through it."""
    ordered = Window.partitionBy("block").orderBy(order)
    ends = rows.withColumn("block", F.expr(f"{order} div {ROWS_PER_FILE}")).repartition("block")
    ends = ends.withColumns({"first": F.lag(order).over(ordered).isNull(), "last": F.lead(order).over(ordered).isNull()})
    ends.sortWithinPartitions("block", order).select("block", line.alias("value")).write.partitionBy("block").text(path)
    return path


def csv_files(spark: SparkSession, sf_dir: str, path: str) -> str:
    """All customers as files: names with quotes and line breaks, every tenth row one cell short."""
    key = F.col("c_custkey")
    name = F.concat(F.lit(',"'), "c_name", F.lit(', ""q""'), F.when(key % 5 == 0, "\nline").otherwise(""), F.lit('"'))
    nation = F.when(key % 10 == 0, "").otherwise(F.concat(F.lit(","), F.col("c_nationkey").cast("string")))
    line = F.concat(F.when(F.col("first"), "key,name,nation\n").otherwise(""), key.cast("string"), name, nation)
    return _as_files(table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey"), "c_custkey", line, path)


def json_files(spark: SparkSession, sf_dir: str, path: str) -> str:
    """All events as files, each an array."""
    item = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "type": "a,['), "event_type", F.lit('", "props": '), "props", F.lit("}"))
    line = F.concat(F.when(F.col("first"), "[").otherwise(""), item, F.when(F.col("last"), "]").otherwise(","))
    return _as_files(events(spark, sf_dir), "event_id", line, path)


def json_user_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('": '), "props")
    return (
        events(spark, sf_dir)
        .groupBy("user_id", F.expr(f"event_id div {EVENTS_PER_BLOCK}").alias("block"))
        .agg(ordered_concat(F.col("event_id"), member, ", ").alias("members"))
        .select(
            F.concat_ws("/", F.col("user_id").cast("string"), "block").alias("doc_id"),
            F.concat(F.lit("{"), "members", F.lit("}")).alias("json"),
        )
    )


def csv_customers(spark: SparkSession, sf_dir: str, by: str = "c_mktsegment") -> DataFrame:
    """CSV files of customers with quoted fields; every tenth row is one cell short."""
    row = F.concat(
        F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""q"""'),
        F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.concat(F.lit(","), F.col("c_nationkey").cast("string"))),
    )
    return (
        table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        .groupBy(F.col(by).cast("string").alias("by"), F.expr(f"c_custkey div {ROWS_PER_BLOCK}").alias("block"))
        .agg(ordered_concat(F.col("c_custkey"), row, "\n").alias("rows"))
        .select(
            F.concat_ws("/", "by", "block").alias("doc_id"),
            F.concat(F.lit("key,name,nation\n"), "rows", F.lit("\n")).alias("csv"),
        )
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def text_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.concat(F.lit("Section "), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("\n"), "text")
    return (
        conversations(spark, sf_dir)
        .groupBy("conv_id", F.expr(f"turn div {TURNS_PER_BLOCK}").alias("block"))
        .agg(ordered_concat(F.col("turn"), turn, "\n").alias("text"))
        .select(F.concat_ws("/", F.col("conv_id").cast("string"), "block").alias("doc_id"), "text")
    )


def text_all_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of hardly anything but headings: every run of words becomes a line of four in capitals."""
    words = F.filter(F.split(F.upper("text"), r"\s+", -1), lambda w: w != "")
    lines = F.transform(
        F.sequence(F.lit(0), F.expr("CAST(greatest(size(words) - 1, 0) div 4 AS INT)")),
        lambda i: F.array_join(F.slice(F.col("words"), i * 4 + 1, F.lit(4)), " "),
    )
    rows = documents(spark, sf_dir).select("doc_id", words.alias("words"))
    return rows.select("doc_id", F.array_join(lines, "\n\n").alias("text"))


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text extracted from PDFs: missing for some, blank for others."""
    text = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 13 == 0, " \n ").otherwise(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"),
        text.alias("pdf_text"),
        F.lit("application/pdf").alias("content_type"),
        F.encode(F.concat(F.lit("%PDF "), F.col("doc_id").cast("string")), "UTF-8").alias("body"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").cast("timestamp").alias("fetched_at"),
    )


EXTENSIONS = [".md", ".TXT", ".png", ".json", ""]


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of archives, with a directory entry first; some archives break off."""
    suffix = F.lit("")
    for i, text in enumerate(EXTENSIONS):
        suffix = F.when(F.col("doc_id") % 5 == i, text).otherwise(suffix)
    archive = F.concat_ws("/", "source", F.expr(f"doc_id div {DOCS_PER_BLOCK}").cast("string"))
    docs = documents(spark, sf_dir).withColumn("archive_id", archive)
    members = docs.select(
        "archive_id",
        (F.col("doc_id") + 1).alias("entry_index"),
        F.concat("lang", F.lit("/Doc "), F.col("doc_id").cast("string"), suffix).alias("entry_name"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.lit(False).alias("is_directory"),
        "text",
        F.lit(False).alias("failed"),
    ).withColumnRenamed("text", "content")
    directories = (
        docs.select("archive_id").distinct().select(
            "archive_id", F.lit(0).cast("bigint").alias("entry_index"), F.lit("docs/").alias("entry_name"),
            F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("is_directory"),
            F.lit(None).cast("string").alias("content"), F.lit(False).alias("failed"),
        )
    )
    return members.unionByName(directories)


def broken_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives, those of some sources broken off at their end, and further ones of which nothing could be read."""
    members = archive_members(spark, sf_dir)
    number = F.regexp_extract("archive_id", r"^src(\d+)/", 1).cast("int") % 5
    ends = members.filter(F.col("is_directory") & number.isin(0, 1)).withColumns(
        {
            "archive_id": F.concat(F.when(number == 0, "lost/").otherwise(""), "archive_id"),
            "failed": F.lit(True),
            "entry_index": F.lit(1 << 40).cast("bigint"),
        }
    )
    return members.unionByName(ends)


def fetch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"),
        F.concat(F.lit("https://example.org/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("url"),
        F.lit("text/html").alias("content_type"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
    )


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per conversation, twelve hours apart."""
    return (
        conversations(spark, sf_dir)
        .filter(F.col("turn") == 0)
        .select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("record_id"),
            F.concat(F.lit("https://example.org/c/"), F.col("conv_id").cast("string")).alias("url"),
            F.lit("text/markdown").alias("content_type"),
            F.expr("TIMESTAMP_NTZ '2023-12-20 00:00:00' + make_dt_interval(0, CAST(conv_id * 12 AS INT), 0, 0)")
            .cast("timestamp")
            .alias("fetched_at"),
        )
    )


def record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks; keys repeat within a record."""
    return conversations(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("record_id"),
        F.col("turn").cast("int").alias("chunk_index"),
        slug(F.col("role")).alias("key"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for records and keys, some of which do not exist."""
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer", "c_custkey").select(
        F.concat(F.lit("c"), F.expr("c_custkey div 10").cast("string")).alias("record_id"),
        F.when(k == 0, "user").when(k == 1, "assistant").otherwise("nope").alias("key"),
    ).distinct()


def audit_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes, some with a byte order mark, CR LF line ends, or a broken sequence."""
    k = F.col("doc_id") % 6
    body = F.encode("text", "UTF-8")
    changed = (
        F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), body))
        .when(k == 2, F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"))
        .when(k == 3, F.concat(body, F.unhex(F.lit("E282"))))
        .otherwise(body)
    )
    return documents(spark, sf_dir).select("doc_id", changed.alias("body"))


PATHS = ["src/a/{}.ts", "docs/{}.md", "dist/{}.js", "tools/{}.db", "{}.md", "{}.txt", "src/node_modules/{}.js", "other/{}.md", "src/.git/{}"]


def audit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every document."""
    path = F.lit(None).cast("string")
    for i, template in enumerate(PATHS):
        before, after = template.split("{}")
        text = F.concat(F.lit(before), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(after))
        path = F.when(F.col("doc_id") % len(PATHS) == i, text).otherwise(path)
    return table(spark, sf_dir, "documents", "doc_id", "source").select("doc_id", path.alias("path"))
