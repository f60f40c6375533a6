"""Registered queries: display-side classifications and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions import display as Dp
from contrail.functions import numeric as N
from contrail.functions.numeric import strip_ws
from contrail.functions.time import lenient_instant, ntz, time_until_label
from contrail.plans import params as P
from contrail.plans.oracle_ctes import AS_OF_SQL, CAND, FS, sql_instant, with_ctes
from contrail.plans.registry import register
from contrail.plans.routes_q import cached_routes, candidates
from contrail.plans.snapshot_q import _snapshot_sql
from contrail.plans.tracking_q import snap
from contrail.plans.trails_q import history


# ---------------------------------------------------------------- F14
@register("altitude_band", with_ctes(FS) + """
SELECT CASE WHEN on_ground = TRUE THEN 'ground'
            WHEN COALESCE(baro_altitude, CAST(0 AS DOUBLE)) > 10000 THEN 'high'
            WHEN COALESCE(baro_altitude, CAST(0 AS DOUBLE)) > 5000 THEN 'mid' ELSE 'low' END AS band,
       CAST(count(*) AS BIGINT) AS n
FROM fs GROUP BY 1""")
def altitude_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.groupBy(Dp.altitude_band(F.col("on_ground"), F.col("baro_altitude")).alias("band")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- F16
@register("vertical_trend", with_ctes(FS) + """
SELECT CASE WHEN vertical_rate IS NULL THEN NULL WHEN vertical_rate > 1 THEN 'up'
            WHEN vertical_rate < -1 THEN 'down' ELSE 'level' END AS trend,
       CAST(count(*) AS BIGINT) AS n
FROM fs GROUP BY 1""")
def vertical_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.groupBy(Dp.vertical_trend(F.col("vertical_rate")).alias("trend")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


# ---------------------------------------------------------------- F15
@register("unit_display", with_ctes(FS) + """
SELECT event_id,
       CAST(floor(baro_altitude * CAST(3.28084 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS altitude_ft,
       CAST(floor(velocity * CAST(1.94384 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS speed_kt,
       CAST(floor(vertical_rate * CAST(196.85 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS rate_fpm
FROM fs""")
def unit_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.select("event_id", N.feet(F.col("baro_altitude")).alias("altitude_ft"),
                    N.knots(F.col("velocity")).alias("speed_kt"),
                    N.feet_per_minute(F.col("vertical_rate")).alias("rate_fpm"))


# ---------------------------------------------------------------- F17
def _delay_sql(x: str) -> str:
    m = f"CAST(floor(CAST({x} AS DOUBLE) / CAST(60 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"
    return (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN 'On time' WHEN {m} > 0 THEN '+' || CAST({m} AS VARCHAR) || ' min late' "
            f"ELSE CAST(abs({m}) AS VARCHAR) || ' min early' END")


@register("delay_label", with_ctes(CAND) + f"""
SELECT pos, {_delay_sql('departure_delay')} AS departure_label, {_delay_sql('arrival_delay')} AS arrival_label FROM cand""")
def delay_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.select("pos", Dp.delay_label(F.col("departure_delay")).alias("departure_label"),
                    Dp.delay_label(F.col("arrival_delay")).alias("arrival_label"))


# ---------------------------------------------------------------- F18
_ETA = sql_instant("COALESCE(NULLIF(estimated_on, ''), NULLIF(scheduled_on, ''))")
_DIFF = f"(CAST(date_diff('microsecond', {AS_OF_SQL}, eta) AS DOUBLE) / CAST(1000 AS DOUBLE))"
_TOT = f"CAST(floor({_DIFF} / CAST(60000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


@register("time_until", with_ctes(CAND, f"e AS (SELECT pos, {_ETA} AS eta FROM cand)") + f"""
SELECT pos,
  CASE WHEN eta IS NULL THEN NULL
       WHEN {_DIFF} <= 0 THEN 'Arriving'
       WHEN CAST(floor({_TOT} / 60) AS BIGINT) > 0
         THEN CAST(CAST(floor({_TOT} / 60) AS BIGINT) AS VARCHAR) || 'h ' || CAST(({_TOT} % 60 + 60) % 60 AS VARCHAR) || 'm'
       ELSE CAST(({_TOT} % 60 + 60) % 60 AS VARCHAR) || 'm' END AS label
FROM e""")
def time_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    eta = lenient_instant(Dp.alert_eta_text(F.col("estimated_on"), F.col("scheduled_on")))
    return c.select("pos", time_until_label(eta, ntz(P.AS_OF)).alias("label"))


# ---------------------------------------------------------------- F11
@register("eta_choice", with_ctes(CAND) + """
SELECT pos, COALESCE(NULLIF(estimated_on, ''), NULLIF(scheduled_on, '')) AS alert_eta,
       COALESCE(actual_on, estimated_on, scheduled_on) AS display_eta,
       CASE WHEN NULLIF(actual_on, '') IS NOT NULL THEN 'LANDED' ELSE 'ETA' END AS eta_label
FROM cand""")
def eta_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.select(
        "pos",
        Dp.alert_eta_text(F.col("estimated_on"), F.col("scheduled_on")).alias("alert_eta"),
        Dp.display_eta_text(F.col("actual_on"), F.col("estimated_on"), F.col("scheduled_on")).alias("display_eta"),
        Dp.eta_label(F.col("actual_on")).alias("eta_label"),
    )


# ---------------------------------------------------------------- F19
@register("display_name", with_ctes(CAND, *_snapshot_sql(P.LIVE_MAX_AGE)) + """
SELECT s.icao24,
  COALESCE(NULLIF(r.flight_number, ''), NULLIF(regexp_replace(s.callsign, '^\\s+|\\s+$', '', 'g'), ''), upper(s.icao24)) AS display_name
FROM snap s LEFT JOIN valid_routes r ON regexp_replace(s.callsign, '^\\s+|\\s+$', '', 'g') = r.callsign""")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snap(spark, sf_dir)
    r = cached_routes(spark, sf_dir).select(F.col("callsign").alias("_rcs"), "flight_number")
    j = s.join(r, strip_ws(s["callsign"]) == r["_rcs"], "left")
    return j.select("icao24", Dp.display_name(F.col("flight_number"), F.col("callsign"), F.col("icao24")).alias("display_name"))
