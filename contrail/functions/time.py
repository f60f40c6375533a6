"""Instants, ages and countdowns.

All instants are TIMESTAMP_NTZ holding UTC wall-clock time; the session zone
is UTC (see contrail.session).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrail.functions.text import blank_to_null


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from text or a naive datetime."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def lenient_instant(text: Column) -> Column:
    """ISO text -> instant; ``Z``/offsets honoured, zone-less is UTC,
    empty or unparseable -> null. The text must begin with a whole date: a
    year, a month or a time of day alone (which would mean today) is none."""
    whole = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), text)
    return F.try_to_timestamp(blank_to_null(whole)).cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """Instant -> ISO-8601 text with an explicit UTC offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def minutes_between(earlier: Column, later: Column) -> Column:
    """fractional minutes from ``earlier`` to ``later``."""
    return micros_between(earlier, later).cast("double") / F.lit(60_000_000.0)


def time_until_label(eta: Column, as_of: Column) -> Column:
    """``Arriving`` when due, else ``Hh Mm`` / ``Mm`` of rounded minutes."""
    diff_ms = micros_between(as_of, eta).cast("double") / F.lit(1000.0)
    total = F.floor(diff_ms / F.lit(60000.0) + F.lit(0.5)).cast("bigint")
    h = F.floor(total / F.lit(60)).cast("bigint")
    m = F.pmod(total, F.lit(60))
    return (
        F.when(eta.isNull(), F.lit(None).cast("string"))
        .when(diff_ms <= 0, F.lit("Arriving"))
        .when(h > 0, F.format_string("%dh %dm", h, m))
        .otherwise(F.format_string("%dm", m))
    )
