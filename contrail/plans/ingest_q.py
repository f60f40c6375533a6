"""Registered queries: raw clean-up, counters, box, wire JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.numeric import safe_bool
from contrail.operators import clean as C
from contrail.plans import params as P
from contrail.plans.oracle_ctes import FS, RAW, with_ctes
from contrail.plans.registry import register
from contrail.plans.snapshot_q import wire_states
from contrail.plans.trails_q import history
from contrail.schema import HISTORY_COLUMNS_WITH_CATEGORY
from contrail.sinks.wire import to_wire
from contrail.sources.standins import raw_aircraft
from contrail.sources.tables import table
from contrail.sources.wire import parse_states

_BOX_SQL = "lat_n BETWEEN {0} AND {1} AND lon_n BETWEEN {2} AND {3} AND NOT isnan(lat_n) AND NOT isnan(lon_n)".format(
    *[f"CAST({v} AS DOUBLE)" for v in P.BBOX])


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalise(raw_aircraft(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------- S2 P1 F1-F5
@register("clean_raw", with_ctes(RAW) + f"""
SELECT event_id, {", ".join(C.STATE_OUT)} FROM norm WHERE reject_reason IS NULL""")
def clean_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accepted(_normalised(spark, sf_dir)).select("event_id", *C.STATE_OUT)


# ---------------------------------------------------------------- A9
@register("reject_reasons", with_ctes(RAW) + f"""
SELECT COALESCE(reject_reason, CASE WHEN NOT COALESCE({_BOX_SQL}, FALSE) THEN 'outside_box' END, 'published') AS outcome,
       CAST(count(*) AS BIGINT) AS n
FROM norm GROUP BY 1""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ingest_counters(_normalised(spark, sf_dir), P.BBOX).select("outcome", F.col("n").cast("bigint"))


# ---------------------------------------------------------------- P2
@register("bbox_filter", with_ctes(FS) + """
SELECT event_id, icao24, latitude, longitude FROM fs
WHERE latitude BETWEEN CAST(24 AS DOUBLE) AND CAST(50 AS DOUBLE)
  AND longitude BETWEEN CAST(-125 AS DOUBLE) AND CAST(-66 AS DOUBLE)""")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.filter(C.within_box(F.col("latitude"), F.col("longitude"), P.BBOX)).select(
        "event_id", "icao24", "latitude", "longitude")


# ---------------------------------------------------------------- P3
@register("bbox_cover", with_ctes(FS, """
boxes AS (
  SELECT icao24, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon
  FROM fs WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY icao24
)""") + """
SELECT icao24, min_lat, max_lat, min_lon, max_lon,
  CASE WHEN g THEN CAST(0 AS DOUBLE) ELSE (min_lat + max_lat) / CAST(2 AS DOUBLE) END AS center_lat,
  CASE WHEN g THEN CAST(0 AS DOUBLE) ELSE (min_lon + max_lon) / CAST(2 AS DOUBLE) END AS center_lon,
  CASE WHEN g THEN 10000 ELSE least(CAST(floor(sqrt(
      pow((max_lat - min_lat) / CAST(2 AS DOUBLE) * CAST(60 AS DOUBLE), 2) +
      pow((max_lon - min_lon) / CAST(2 AS DOUBLE) * CAST(60 AS DOUBLE) * cos(radians((min_lat + max_lat) / CAST(2 AS DOUBLE))), 2)))
      AS INTEGER) + 100, 3000) END AS radius_nm
FROM (SELECT *, (min_lat <= -89 AND max_lat >= 89 AND min_lon <= -179 AND max_lon >= 179) AS g FROM boxes)""")
def bbox_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    boxes = h.groupBy("icao24").agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))
    return C.covering_circles(boxes)


# ---------------------------------------------------------------- P4 P5 P8 F7
_HIST = ", ".join(HISTORY_COLUMNS_WITH_CATEGORY)
_NULL_HIST = ", ".join(
    ("'CRUISE'" if c == "flight_phase" else "NULL") + f" AS {c}" for c in HISTORY_COLUMNS_WITH_CATEGORY)


@register("parse_wire_json", with_ctes(FS) + f"""
SELECT {_HIST} FROM fs WHERE event_id % 113 <> 0
UNION ALL
SELECT {_NULL_HIST} FROM fs WHERE event_id % 113 = 0""")
def parse_wire_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire_states(spark, sf_dir, *HISTORY_COLUMNS_WITH_CATEGORY)


# ---------------------------------------------------------------- K1 K5
_RT = ["icao24", "callsign", "latitude", "longitude", "baro_altitude", "geo_altitude", "on_ground", "velocity",
       "true_track", "vertical_rate", "squawk", "category", "ingested_at"]


@register("wire_json_roundtrip", with_ctes(FS) + """
SELECT icao24 AS key, CAST(13 AS BIGINT) AS n_fields, icao24, callsign, latitude, longitude, baro_altitude,
       geo_altitude, on_ground, velocity, true_track, vertical_rate, squawk, category,
       strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') AS ingested_at
FROM fs""")
def wire_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = to_wire(history(spark, sf_dir))
    back = parse_states(wire.withColumn("n_fields", F.size(F.json_object_keys("value")).cast("bigint")),
                        keep=("key", "n_fields"))
    return back.select("key", "n_fields", *_RT)


# ---------------------------------------------------------------- F2
@register("safe_bool", """
SELECT event_id,
  CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'yes'
                    WHEN 4 THEN 'no' WHEN 5 THEN '0' WHEN 6 THEN '' END AS flag_text,
  COALESCE(lower(CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'yes'
                    WHEN 4 THEN 'no' WHEN 5 THEN '0' WHEN 6 THEN '' END) IN ('true', '1', 'yes'), FALSE) AS from_text,
  COALESCE(user_id % 3 <> 0, FALSE) AS from_number,
  COALESCE(event_type = 'purchase', FALSE) AS from_boolean
FROM events""")
def safe_bool_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 8
    text = (F.when(k == 0, "true").when(k == 1, "TRUE").when(k == 2, "1").when(k == 3, "yes")
            .when(k == 4, "no").when(k == 5, "0").when(k == 6, ""))
    return e.select(
        "event_id", text.alias("flag_text"),
        safe_bool(text).alias("from_text"),
        safe_bool(F.col("user_id") % 3, kind="number").alias("from_number"),
        safe_bool(F.col("event_type") == "purchase", kind="boolean").alias("from_boolean"),
    )
