"""Canonical record schema, defined once; every other shape derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

# The state record as it travels on the wire (field order is fixed).
STATE_FIELDS = [
    ("icao24", StringType()),
    ("callsign", StringType()),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("baro_altitude", DoubleType()),
    ("geo_altitude", DoubleType()),
    ("on_ground", BooleanType()),
    ("velocity", DoubleType()),
    ("true_track", DoubleType()),
    ("vertical_rate", DoubleType()),
    ("squawk", StringType()),
    ("category", StringType()),
    ("ingested_at", StringType()),
]
STATE_SCHEMA = StructType([StructField(n, t, True) for n, t in STATE_FIELDS])
STATE_COLUMNS = [n for n, _ in STATE_FIELDS]

# History rows: the 14 columns of the history table plus `category`, which
# we keep in both stores (the two copies of the reference disagree on it).
HISTORY_COLUMNS = [
    "time", "icao24", "callsign", "latitude", "longitude",
    "baro_altitude", "geo_altitude", "velocity", "true_track",
    "vertical_rate", "on_ground", "flight_phase", "squawk", "ingested_at",
]
HISTORY_COLUMNS_WITH_CATEGORY = HISTORY_COLUMNS[:13] + ["category", "ingested_at"]

# Raw poll aircraft object: every leaf is read as text, because `alt_baro`
# mixes numbers and the word "ground".
RAW_AIRCRAFT_FIELDS = ["hex", "flight", "lat", "lon", "alt_baro", "alt_geom", "gs",
                       "baro_rate", "track", "squawk", "category"]
RAW_AIRCRAFT_SCHEMA = StructType([StructField(n, StringType(), True) for n in RAW_AIRCRAFT_FIELDS])
RAW_POLL_SCHEMA = StructType([StructField("ac", ArrayType(RAW_AIRCRAFT_SCHEMA), True)])


def history_projection(df: DataFrame, with_category: bool = True) -> DataFrame:
    """The fixed history column list."""
    cols = HISTORY_COLUMNS_WITH_CATEGORY if with_category else HISTORY_COLUMNS
    return df.select(*cols)


def client_columns(df: DataFrame, phase_default: str = "CRUISE") -> list[Column]:
    """The client projection with its renames."""
    return [
        F.col("icao24"),
        F.col("callsign"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("baro_altitude").alias("altitude"),
        F.col("velocity"),
        F.col("true_track").alias("heading"),
        F.col("vertical_rate"),
        F.col("on_ground"),
        F.coalesce(F.col("flight_phase"), F.lit(phase_default)).alias("flight_phase"),
        F.col("category"),
    ]


def client_projection(df: DataFrame, phase_default: str = "CRUISE") -> DataFrame:
    return df.select(*client_columns(df, phase_default))
