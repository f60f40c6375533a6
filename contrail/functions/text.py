"""Identifier and callsign clean-up, composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrail.functions.numeric import strip_ws


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_icao24(c: Column) -> Column:
    """Stripped and lower-cased transponder id; blank -> null."""
    return blank_to_null(F.lower(strip_ws(c)))


def clean_callsign(c: Column) -> Column:
    """Stripped callsign; empty -> null."""
    return blank_to_null(strip_ws(c))


def first_non_empty(*cols: Column) -> Column:
    """Python's ``a or b or c`` over text: skips null and empty values."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def subscription_key(icao24: Column, email: Column) -> list[Column]:
    """the two-column key of a subscription."""
    return [F.lower(icao24).alias("sub_icao24"), F.lower(email).alias("sub_email")]
