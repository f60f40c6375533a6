"""Registered queries: bearings, path length, interpolation, deadband."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators import geo as G
from contrail.operators.trails import hourly
from contrail.plans.oracle_ctes import FS, PTS_SEG, with_ctes
from contrail.plans.registry import register
from contrail.plans.trails_q import history

FRACTIONS = (0.0, 0.25, 0.5, 0.75, 1.0)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.segments(history(spark, sf_dir), bucket=hourly())


# ---------------------------------------------------------------- W6
@register("bearing_segments", with_ctes(FS, PTS_SEG) + "\nSELECT icao24, event_id, (round(bearing, 6) + CAST(0 AS DOUBLE)) AS bearing FROM seg")
def bearing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("icao24", "event_id", F.round("bearing", 6).alias("bearing"))


# ---------------------------------------------------------------- W7
@register("path_length", with_ctes(FS, PTS_SEG) + """
SELECT icao24, event_id, (round(seg_len, 6) + CAST(0 AS DOUBLE)) AS seg_len, (round(CAST(cum_end AS DOUBLE), 6) + CAST(0 AS DOUBLE)) AS cum_len FROM cum""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    pl = G.path_lengths(_segments(spark, sf_dir), bucket=F.date_trunc("day", "time"))
    return pl.select("icao24", "event_id", F.round("seg_len", 6).alias("seg_len"),
                     F.round(F.col("cum_end").cast("double"), 6).alias("cum_len"))


# ---------------------------------------------------------------- J10 F20
# (DuckDB's round can return -0.0 where Spark's returns 0.0; the oracle adds
# 0.0 to its rounded columns, which changes no other value.)
_FRAC_SQL = ", ".join(f"(CAST({f} AS DOUBLE))" for f in FRACTIONS)


@register("route_interpolation", with_ctes(FS, PTS_SEG, f"""
c2 AS (SELECT *, CAST(cum_end - CAST(seg_len AS DECIMAL(24,12)) AS DOUBLE) AS s, CAST(cum_end AS DOUBLE) AS e,
              ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time, event_id) AS k FROM cum),
tot AS (SELECT icao24, max(e) AS total FROM c2 GROUP BY icao24),
fr AS (SELECT * FROM (VALUES {_FRAC_SQL}) AS t(fraction)),
pos AS (SELECT tot.icao24, fr.fraction, tot.total * fr.fraction AS pos FROM tot, fr),
hit AS (
  SELECT p.icao24, p.fraction, c.event_id AS segment_end_event,
         CASE WHEN c.seg_len > 0 THEN (p.pos - c.s) / c.seg_len ELSE CAST(0 AS DOUBLE) END AS t,
         c.lat1, c.lat2, c.lon1, c.lon2, c.bearing
  FROM pos p JOIN c2 c ON p.icao24 = c.icao24
  WHERE (c.s < p.pos AND p.pos <= c.e) OR (p.pos = 0 AND c.k = 1)
)""") + """
SELECT icao24, fraction, segment_end_event, (round(lat1 + (lat2 - lat1) * t, 6) + CAST(0 AS DOUBLE)) AS lat,
       (round(lon1 + (lon2 - lon1) * t, 6) + CAST(0 AS DOUBLE)) AS lon, (round(bearing, 6) + CAST(0 AS DOUBLE)) AS heading FROM hit""")
def route_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = G.path_lengths(_segments(spark, sf_dir), bucket=F.date_trunc("day", "time"))
    out = G.interpolate_along(lengths, FRACTIONS, bucket_width=50.0)
    return out.select("icao24", "fraction", "segment_end_event", F.round("lat", 6).alias("lat"),
                      F.round("lon", 6).alias("lon"), F.round("heading", 6).alias("heading"))


# ---------------------------------------------------------------- P17
# The fold as a recursive CTE: step k of every aircraft at once, carrying the
# last kept point (recursion depth = the longest path, not the row count).
_MOVED = ("(abs(p.longitude - f.ref_lon) >= CAST(0.001 AS DOUBLE) "
          "OR abs(p.latitude - f.ref_lat) >= CAST(0.001 AS DOUBLE))")
_DEADBAND_SQL = "WITH RECURSIVE " + with_ctes(FS, f"""
pts AS (SELECT icao24, time, event_id, latitude, longitude,
               ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time, event_id) AS k
        FROM fs WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
fold AS (
  SELECT icao24, k, latitude AS ref_lat, longitude AS ref_lon, TRUE AS kept FROM pts WHERE k = 1
  UNION ALL
  SELECT p.icao24, p.k,
         CASE WHEN {_MOVED} THEN p.latitude ELSE f.ref_lat END,
         CASE WHEN {_MOVED} THEN p.longitude ELSE f.ref_lon END,
         {_MOVED}
  FROM fold f JOIN pts p ON p.icao24 = f.icao24 AND p.k = f.k + 1
)""")[len("WITH "):] + """
SELECT p.icao24, p.time, p.event_id, p.latitude, p.longitude FROM fold f JOIN pts p ON p.icao24 = f.icao24 AND p.k = f.k
WHERE f.kept"""


@register("deadband", _DEADBAND_SQL)
def deadband(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.deadband(history(spark, sf_dir), threshold=0.001)
