"""Display-side classifications and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contrail.functions.numeric import round_half_up, strip_ws
from contrail.functions.text import blank_to_null, first_non_empty


def category_class(category: Column) -> Column:
    """emitter category -> icon class."""
    return (
        F.when(category == "A7", "helicopter")
        .when(category == "B2", "balloon")
        .when(category == "B1", "glider")
        .when(category == "B6", "drone")
        .otherwise("plane")
    )


def altitude_band(on_ground: Column, altitude: Column) -> Column:
    """ground / high (>10,000 m) / mid (>5,000 m) / low; null altitude is 0."""
    alt = F.coalesce(altitude, F.lit(0.0))
    return (
        F.when(on_ground == F.lit(True), "ground")
        .when(alt > 10000, "high")
        .when(alt > 5000, "mid")
        .otherwise("low")
    )


def vertical_trend(vertical_rate: Column) -> Column:
    """F16: up / down / level beyond +/-1 m/s; null stays null."""
    return (
        F.when(vertical_rate.isNull(), F.lit(None).cast("string"))
        .when(vertical_rate > 1, "up")
        .when(vertical_rate < -1, "down")
        .otherwise("level")
    )


def delay_label(seconds: Column) -> Column:
    """0/null -> On time; else rounded minutes late / early."""
    m = round_half_up(seconds / F.lit(60.0))
    return (
        F.when(seconds.isNull() | (seconds == 0) | F.isnan(seconds.cast("double")), F.lit("On time"))
        .when(m > 0, F.format_string("+%d min late", m))
        .otherwise(F.format_string("%d min early", F.abs(m)))
    )


def display_name(flight_number: Column, callsign: Column, icao24: Column) -> Column:
    """flight number, else trimmed callsign, else upper-case id."""
    return F.coalesce(blank_to_null(flight_number), blank_to_null(strip_ws(callsign)), F.upper(icao24))


def alert_eta_text(estimated_on: Column, scheduled_on: Column) -> Column:
    """F11 (alert): first non-empty of estimated, scheduled."""
    return first_non_empty(estimated_on, scheduled_on)


def display_eta_text(actual_on: Column, estimated_on: Column, scheduled_on: Column) -> Column:
    """F11 (display): first non-null of actual, estimated, scheduled."""
    return F.coalesce(actual_on, estimated_on, scheduled_on)


def eta_label(actual_on: Column) -> Column:
    """F11 (label): LANDED when ``actual_on`` is non-empty, else ETA."""
    return F.when(blank_to_null(actual_on).isNotNull(), "LANDED").otherwise("ETA")
