"""Registered queries: recent trails, full flight, take-offs, phase events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators import trails as T
from contrail.plans import params as P
from contrail.plans.oracle_ctes import AS_OF_SQL, FS, with_ctes
from contrail.plans.registry import register
from contrail.sources.standins import flight_states
from contrail.sources.tables import table


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight_states(table(spark, sf_dir, "events"))


# ---------------------------------------------------------------- W1 P9 L1
_TRAIL_POINTS_SQL = with_ctes(FS, f"""
ranked AS (
  SELECT icao24, time, event_id, latitude AS lat, longitude AS lon, flight_phase,
         CAST(ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS BIGINT) AS rn
  FROM fs
  WHERE time > {AS_OF_SQL} - INTERVAL '{P.TRAIL_SPAN}'
    AND latitude IS NOT NULL AND longitude IS NOT NULL
)""") + f"""
SELECT * FROM ranked WHERE rn <= {P.TRAIL_POINTS} ORDER BY icao24, rn DESC"""


@register("trail_points", _TRAIL_POINTS_SQL)
def trail_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.recent_trail_points(history(spark, sf_dir), P.AS_OF, P.TRAIL_SPAN, P.TRAIL_POINTS)


# ---------------------------------------------------------------- A3
_TRAIL_PATHS_SQL = with_ctes(FS, f"""
ranked AS (
  SELECT icao24, time, event_id, latitude AS lat, longitude AS lon, flight_phase,
         ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rn
  FROM fs
  WHERE time > {AS_OF_SQL} - INTERVAL '{P.TRAIL_SPAN}'
    AND latitude IS NOT NULL AND longitude IS NOT NULL
),
pts AS (SELECT * FROM ranked WHERE rn <= {P.TRAIL_POINTS})""") + """
SELECT icao24,
       arg_min(flight_phase, rn) AS phase,
       CAST(count(*) AS BIGINT) AS n_points,
       arg_max(lon, rn) AS first_lon, arg_max(lat, rn) AS first_lat,
       arg_min(lon, rn) AS last_lon, arg_min(lat, rn) AS last_lat
FROM pts GROUP BY icao24 HAVING count(*) >= 2"""


@register("trail_paths", _TRAIL_PATHS_SQL)
def trail_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = T.recent_trail_points(history(spark, sf_dir), P.AS_OF, P.TRAIL_SPAN, P.TRAIL_POINTS, ordered=False)
    return T.path_summary(T.trail_paths(pts))


# ---------------------------------------------------------------- W2 W3 L3
_TAKEOFF_CTE = f"""
tr AS (
  SELECT icao24, time, event_id, flight_phase,
         LAG(flight_phase) OVER (PARTITION BY icao24 ORDER BY time, event_id) AS prev_phase
  FROM fs WHERE time > {AS_OF_SQL} - INTERVAL '{P.FULL_FLIGHT_LOOKBACK}'
),
takeoff AS (
  SELECT icao24, max(time) AS takeoff_time FROM tr
  WHERE flight_phase <> 'GROUND' AND (prev_phase = 'GROUND' OR prev_phase IS NULL)
  GROUP BY icao24
)"""

_LAST_TAKEOFF_SQL = with_ctes(FS, _TAKEOFF_CTE) + "\nSELECT icao24, takeoff_time FROM takeoff"


@register("last_takeoff", _LAST_TAKEOFF_SQL)
def last_takeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last_takeoff(history(spark, sf_dir), P.AS_OF, P.FULL_FLIGHT_LOOKBACK, bucket=T.hourly())


# ---------------------------------------------------------------- S5 J9 L2
_FULL_POINTS_CTE = f"""
pts AS (
  SELECT f.icao24, f.time, f.event_id, f.latitude AS lat, f.longitude AS lon, f.flight_phase
  FROM fs f LEFT JOIN takeoff t ON f.icao24 = t.icao24
  WHERE f.latitude IS NOT NULL AND f.longitude IS NOT NULL
    AND f.time >= COALESCE(t.takeoff_time, {AS_OF_SQL} - INTERVAL '{P.FULL_FLIGHT_DEFAULT}')
)"""

_FULL_POINTS_SQL = with_ctes(FS, _TAKEOFF_CTE, _FULL_POINTS_CTE) + "\nSELECT * FROM pts ORDER BY icao24, time, event_id"


@register("full_flight_points", _FULL_POINTS_SQL)
def full_flight_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.full_flight_points(history(spark, sf_dir), P.AS_OF, P.FULL_FLIGHT_LOOKBACK, P.FULL_FLIGHT_DEFAULT,
                                bucket=T.hourly(), ordered=True)


# ---------------------------------------------------------------- A4
_FULL_SUMMARY_SQL = with_ctes(FS, _TAKEOFF_CTE, _FULL_POINTS_CTE, f"""
keys AS (SELECT DISTINCT icao24 FROM fs WHERE time > {AS_OF_SQL} - INTERVAL '{P.FULL_FLIGHT_LOOKBACK}'),
agg AS (
  SELECT icao24, count(*) AS n_points,
         arg_max(flight_phase, (time, event_id)) AS phase,
         arg_min(lon, (time, event_id)) AS first_lon, arg_min(lat, (time, event_id)) AS first_lat,
         arg_max(lon, (time, event_id)) AS last_lon, arg_max(lat, (time, event_id)) AS last_lat
  FROM pts GROUP BY icao24
)""") + """
SELECT k.icao24, CAST(COALESCE(a.n_points, 0) AS BIGINT) AS n_points, COALESCE(a.phase, 'CRUISE') AS phase,
       a.first_lon, a.first_lat, a.last_lon, a.last_lat
FROM keys k LEFT JOIN agg a ON k.icao24 = a.icao24"""


@register("full_flight_summary", _FULL_SUMMARY_SQL)
def full_flight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    pts = T.full_flight_points(h, P.AS_OF, P.FULL_FLIGHT_LOOKBACK, P.FULL_FLIGHT_DEFAULT, bucket=T.hourly())
    return T.full_flight_summary(h, pts, P.AS_OF, P.FULL_FLIGHT_LOOKBACK)


# ---------------------------------------------------------------- W4
_EVENTS_SQL = with_ctes(FS, """
tr AS (
  SELECT icao24, time, event_id, flight_phase, latitude, longitude,
         LAG(flight_phase) OVER (PARTITION BY icao24 ORDER BY time, event_id) AS prev_phase
  FROM fs
)""") + """
SELECT icao24,
       CASE WHEN prev_phase = 'GROUND' AND flight_phase <> 'GROUND' THEN 'TAKEOFF'
            WHEN prev_phase <> 'GROUND' AND flight_phase = 'GROUND' THEN 'LANDING' END AS event_type,
       time AS event_time, event_id, latitude, longitude
FROM tr
WHERE (prev_phase = 'GROUND' AND flight_phase <> 'GROUND') OR (prev_phase <> 'GROUND' AND flight_phase = 'GROUND')"""


@register("flight_events", _EVENTS_SQL)
def flight_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.flight_events(history(spark, sf_dir), bucket=F.date_trunc("day", "time"))
