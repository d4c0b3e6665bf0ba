"""Records and chunks: listing, resolving, lookup, retention, labels. Every operator takes the time ``as_of``.

``records``: record_id (unique), url, content_type, fetched_at.
``chunks``: record_id, chunk_index (from 0, without gaps), key, title, content, size_bytes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.functions import labels as L

AsOf = str | datetime | Column


def record_status(records: DataFrame, as_of: AsOf) -> DataFrame:
    return records.select("record_id", "fetched_at", L.status(F.col("fetched_at"), as_of).alias("status"))


def live_records(records: DataFrame, as_of: AsOf) -> DataFrame:
    """Records that are not past retention, with status. The age test is a comparison the Parquet scan can use."""
    # A record without a time counts as fresh here as in its status.
    kept = records.filter((F.col("fetched_at") >= L.expiry_cutoff(as_of)) | F.col("fetched_at").isNull())
    return kept.withColumn("status", L.status(F.col("fetched_at"), as_of))


def list_records(records: DataFrame, as_of: AsOf) -> DataFrame:
    """Newest first; reads no chunks."""
    minutes = L.age_minutes(F.col("fetched_at"), as_of)
    return (
        live_records(records, as_of)
        .select("record_id", "url", "fetched_at", "status", L.age_label(minutes).alias("age"))
        .orderBy(F.desc("fetched_at"), "record_id")
    )


def resolve_records(records: DataFrame, chunks: DataFrame, requests: DataFrame, as_of: AsOf) -> DataFrame:
    """The requested records with status and chunk rows; a record without chunks gives one row.

    An inner join and the records without a match, rather than an outer join: a record with very many chunks can
    then be split over tasks at run time.
    """
    wanted = live_records(records, as_of).join(requests.select("record_id").distinct(), "record_id", "left_semi")
    wanted = wanted.select("record_id", "url", "content_type", "fetched_at", "status")
    detail = chunks.select("record_id", "chunk_index", "key", "title", "size_bytes")
    found = wanted.join(detail, "record_id")
    # Few are wanted, as a rule: the chunk table is reduced to those before anything of it is moved.
    present = chunks.select("record_id").join(wanted.select("record_id"), "record_id", "left_semi").distinct()
    empty = wanted.join(present, "record_id", "left_anti")
    return found.unionByName(empty, allowMissingColumns=True)


def chunk_lookup(
    records: DataFrame, chunks: DataFrame, requests: DataFrame, as_of: AsOf
) -> DataFrame:
    """Content of the requested (record_id, key): the first chunk with that key of a live record.

    Keys may repeat in a record. Requests with a column chunk_index name one chunk by its place as well.

    The first chunk per key is found on the narrow columns of the wanted records, combined before the shuffle; the
    content is then fetched by (record_id, chunk_index), which is unique. Few requests are broadcast by their size;
    many go through a join that can split a large group.
    """
    by = ["record_id", "key", "chunk_index"] if "chunk_index" in requests.columns else ["record_id", "key"]
    wanted = requests.select(*by).distinct()
    wanted = wanted.join(live_records(records, as_of).select("record_id"), "record_id", "left_semi")
    narrow = chunks.select("record_id", "key", "chunk_index").join(wanted, by, "left_semi")
    hits = narrow if "chunk_index" in by else narrow.groupBy("record_id", "key").agg(F.min("chunk_index").alias("chunk_index"))
    return hits.join(
        chunks.select("record_id", "chunk_index", "title", "content"), ["record_id", "chunk_index"]
    ).select("record_id", "key", "chunk_index", "title", "content")


def lookup_misses(records: DataFrame, chunks: DataFrame, requests: DataFrame, as_of: AsOf) -> DataFrame:
    """Requests without a result, and why."""
    live = live_records(records, as_of).select("record_id")
    known = requests.join(live, "record_id", "left_semi")
    no_record = requests.join(live, "record_id", "left_anti").withColumn("reason", F.lit("record not found"))
    pairs = known.select("record_id", "key").distinct()
    keys = chunks.select("record_id", "key").join(pairs, ["record_id", "key"], "left_semi").distinct()
    no_chunk = known.join(keys, ["record_id", "key"], "left_anti").withColumn("reason", F.lit("chunk not found"))
    return no_record.unionByName(no_chunk).select("record_id", "key", "reason")


def _age_base(records: DataFrame) -> Column:
    """When a record without readable time was written stands in for the time of fetching."""
    if "ingested_at" in records.columns:
        return F.coalesce("fetched_at", "ingested_at")
    return F.col("fetched_at")


def retention_survivors(records: DataFrame, as_of: AsOf) -> DataFrame:
    """What a retention run keeps; a record of unknown age is kept."""
    return records.filter(~F.coalesce(_age_base(records) < L.expiry_cutoff(as_of), F.lit(False)))


def surviving_chunks(records: DataFrame, chunks: DataFrame, as_of: AsOf) -> DataFrame:
    return chunks.join(retention_survivors(records, as_of).select("record_id"), "record_id", "left_semi")


def retention_counts(records: DataFrame, as_of: AsOf) -> DataFrame:
    expired = F.coalesce(_age_base(records) < L.expiry_cutoff(as_of), F.lit(False))
    return records.agg(
        F.count("*").alias("n_records"),
        F.count_if(expired).alias("n_deleted"),
        F.count_if(~expired).alias("n_kept"),
    )


def record_summary(chunks: DataFrame) -> DataFrame:
    """Total size, number of chunks, key and content of the first chunk.

    The totals need no content. The preview is the row with index 0, a filter that reaches the Parquet scan, so that
    no other content is read or moved.
    """
    totals = chunks.groupBy("record_id").agg(
        F.sum("size_bytes").alias("total_bytes"), F.count("*").alias("n_chunks")
    )
    first = chunks.filter(F.col("chunk_index") == 0).select(
        "record_id", F.col("key").alias("first_key"), F.col("content").alias("preview")
    )
    return totals.join(first, "record_id").select(
        "record_id", "total_bytes", "n_chunks", L.size_label(F.col("total_bytes")).alias("size"), "first_key", "preview"
    )


def record_index(records: DataFrame, chunks: DataFrame, as_of: AsOf) -> DataFrame:
    """Printable index of every live record, as numbered lines.

    Lines instead of one text per record: no record has to be gathered in one place, however many chunks it has.
    """
    live = live_records(records, as_of)
    fetched = F.date_format(
        F.to_utc_timestamp(F.col("fetched_at").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )
    head = live.select(
        "record_id",
        F.posexplode(
            F.array(
                F.concat(F.lit("URL: "), "url"),
                F.concat(F.lit("Type: "), F.coalesce("content_type", F.lit(""))),
                F.concat(F.lit("Fetched: "), fetched),
                F.concat(F.lit("Status: "), "status"),
                F.lit(""),
                F.lit("Chunks:"),
            )
        ).alias("line_no", "line"),
    )
    number = (F.col("chunk_index") + 1).cast("string")
    # Padding only: a longer number keeps all its digits.
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, " ")).otherwise(number)
    rows = chunks.select("record_id", "chunk_index", "title", "size_bytes").join(live.select("record_id"), "record_id")
    body = rows.select(
        "record_id",
        (F.col("chunk_index") + 6).alias("line_no"),
        F.concat(
            F.lit("  "), padded, F.lit(". "), "title", F.lit("  ("), L.size_label(F.col("size_bytes")), F.lit(")")
        ).alias("line"),
    )
    return head.unionByName(body)


def size_labels(chunks: DataFrame) -> DataFrame:
    return chunks.select("record_id", "chunk_index", "size_bytes", L.size_label(F.col("size_bytes")).alias("size"))


def age_labels(records: DataFrame, as_of: AsOf) -> DataFrame:
    minutes = L.age_minutes(F.col("fetched_at"), as_of)
    return records.select("record_id", minutes.alias("minutes"), L.age_label(minutes).alias("age"))


def duplicate_chunk_keys(chunks: DataFrame) -> DataFrame:
    """Keys that occur more than once in a record; a lookup returns the first."""
    return (
        chunks.groupBy("record_id", "key")
        .agg(F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_index"))
        .filter(F.col("n_chunks") > 1)
    )
