"""Ages, status and the labels shown for sizes and ages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from docpipe.constants import DELETE_AFTER_DAYS, STALE_AFTER_DAYS


def as_timestamp(as_of: str | datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def days_before(as_of: str | datetime | Column, days: int) -> Column:
    """A constant, so that comparisons against it reach the Parquet scan."""
    return as_timestamp(as_of) - F.make_dt_interval(F.lit(days))


def stale_cutoff(as_of: str | datetime | Column) -> Column:
    return days_before(as_of, STALE_AFTER_DAYS)


def expiry_cutoff(as_of: str | datetime | Column) -> Column:
    return days_before(as_of, DELETE_AFTER_DAYS)


def status(fetched_at: Column, as_of: str | datetime | Column) -> Column:
    return (
        F.when(fetched_at < expiry_cutoff(as_of), "expired")
        .when(fetched_at < stale_cutoff(as_of), "stale")
        .otherwise("fresh")
    )


def size_label(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", size.cast("double") / 1024))
        .otherwise(F.format_string("%.1f MB", size.cast("double") / (1024 * 1024)))
    )


def age_minutes(fetched_at: Column, as_of: str | datetime | Column) -> Column:
    """Whole minutes, half a minute rounds up."""
    micros = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(fetched_at)
    return F.floor(micros / F.lit(60_000_000) + F.lit(0.5))


def age_label(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )
