"""Flight phase, one parameterised rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUND, CLIMBING, CRUISE, DESCENDING = "GROUND", "CLIMBING", "CRUISE", "DESCENDING"
PHASES = [GROUND, CLIMBING, CRUISE, DESCENDING]


def flight_phase(
    on_ground: Column | str = "on_ground",
    vertical_rate: Column | str = "vertical_rate",
    baro_altitude: Column | str = "baro_altitude",
    climb: float = 2.0,
    descend: float = -2.0,
    ceiling: float | None = 10000.0,
    null_rate_as_zero: bool = False,
) -> Column:
    """Classify a state.

    Defaults are the rule the stream applies (F8): ground flag first, then
    climbing/descending beyond +/-2 m/s below 10,000 m, else cruise; a null
    rate or altitude gives cruise. ``climb=1, descend=-1, ceiling=None,
    null_rate_as_zero=True`` is the alternative rule (X1).
    """
    og = F.col(on_ground) if isinstance(on_ground, str) else on_ground
    vr = F.col(vertical_rate) if isinstance(vertical_rate, str) else vertical_rate
    alt = F.col(baro_altitude) if isinstance(baro_altitude, str) else baro_altitude
    if null_rate_as_zero:
        vr = F.coalesce(vr, F.lit(0.0))
    up = vr > F.lit(float(climb))
    down = vr < F.lit(float(descend))
    if ceiling is not None:
        low = alt < F.lit(float(ceiling))
        up, down = up & low, down & low
    return (
        F.when(og == F.lit(True), F.lit(GROUND))
        .when(up, F.lit(CLIMBING))
        .when(down, F.lit(DESCENDING))
        .otherwise(F.lit(CRUISE))
    )


# Per-phase display attributes (label, short label, badge colour,
# list colour), in phase order GROUND, CLIMBING, CRUISE, DESCENDING.
PHASE_ATTRIBUTES = [
    ("GROUND", "Ground", "GND", "#a0a0aa", "#a0a0aa"),
    ("CLIMBING", "Climbing", "CLB", "#00dc78", "#00dc78"),
    ("CRUISE", "Cruise", "CRZ", "#00e5ff", "#32a0ff"),
    ("DESCENDING", "Descending", "DSC", "#ffaa00", "#ffaa00"),
]


def phase_attributes(spark: SparkSession) -> DataFrame:
    """the 4-row phase dimension (bounded size: one row per phase)."""
    return spark.createDataFrame(
        PHASE_ATTRIBUTES,
        "flight_phase string, label string, short_label string, badge_color string, list_color string",
    )
