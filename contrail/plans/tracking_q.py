"""Registered queries: tracked list, search, dimensions, level of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators import dims as D
from contrail.operators import latest as L
from contrail.operators import tracking as K
from contrail.plans import params as P
from contrail.plans.alerts_q import subscriptions
from contrail.plans.oracle_ctes import DIM, FS, SEARCHES, SUBS, TRACKED, with_ctes
from contrail.plans.registry import register
from contrail.plans.snapshot_q import _snapshot, _snapshot_sql
from contrail.plans.trails_q import history
from contrail.session import shared_dir
from contrail.sources import standins as S
from contrail.sources.tables import table


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.distinct_tracked(S.track_log(table(spark, sf_dir, "events")))


def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, P.LIVE_MAX_AGE)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    u = F.floor(c / F.lit(10)).cast("bigint")
    cs = S.callsign_of(u)
    k = c % 10
    q = (F.when(k == 0, F.concat(F.lit(" "), F.lower(cs), F.lit(" ")))
         .when(k == 1, S.icao_of(u))
         .when(k == 2, F.concat(F.lit("zz"), c.cast("string")))
         .when(k == 3, F.lower(F.substring(cs, 1, 3)))
         .when(k == 4, F.substring(S.icao_of(u), 1, 4))
         .when(k == 5, F.lit(" x"))
         .when(k == 6, F.concat(F.lower(F.substring(cs, 1, 2)), F.lit(" ")))
         .otherwise(cs))
    return table(spark, sf_dir, "customer").select(q.alias("query")).filter(F.col("query").isNotNull()).distinct()


_SNAP = _snapshot_sql(P.LIVE_MAX_AGE)


# ---------------------------------------------------------------- A11
@register("distinct_tracked", with_ctes(TRACKED) + "\nSELECT icao24, position FROM tracked")
def distinct_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir)


# ---------------------------------------------------------------- J4
@register("tracked_join", with_ctes(TRACKED, *_SNAP) + """
SELECT t.icao24, t.position, s.callsign, s.lat, s.lon, s.altitude, COALESCE(s.flight_phase, 'CRUISE') AS flight_phase
FROM tracked t LEFT JOIN snap s ON t.icao24 = s.icao24 ORDER BY t.position""")
def tracked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tracked_with_snapshot(tracked(spark, sf_dir), snap(spark, sf_dir))


# ---------------------------------------------------------------- J6
@register("tracked_semi", with_ctes(TRACKED, DIM) + """
SELECT * FROM dim WHERE icao24 IN (SELECT icao24 FROM tracked)""")
def tracked_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.metadata_of_tracked(S.aircraft_dim(table(spark, sf_dir, "events")), tracked(spark, sf_dir))


# ---------------------------------------------------------------- J7
@register("tracked_anti", with_ctes(TRACKED, DIM, *_SNAP) + """
SELECT t.icao24, t.position, regexp_replace(s.callsign, '^\\s+|\\s+$', '', 'g') AS callsign
FROM tracked t JOIN snap s ON t.icao24 = s.icao24
WHERE s.callsign IS NOT NULL AND regexp_replace(s.callsign, '^\\s+|\\s+$', '', 'g') <> ''
  AND t.icao24 NOT IN (SELECT icao24 FROM dim)""")
def tracked_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tracked_without_metadata(tracked(spark, sf_dir), snap(spark, sf_dir),
                                      S.aircraft_dim(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------- J8
@register("tracked_alerts", with_ctes(TRACKED, SUBS, """
last_mail AS (SELECT icao24, email FROM (
  SELECT icao24, email, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY created_at DESC, email DESC) AS rk FROM kept)
  WHERE rk = 1)""") + """
SELECT t.icao24, t.position, m.email FROM tracked t LEFT JOIN last_mail m ON t.icao24 = m.icao24""")
def tracked_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tracked_alert_emails(tracked(spark, sf_dir), subscriptions(spark, sf_dir))


# ---------------------------------------------------------------- J1 S8
_AIRLINE_SQL = with_ctes(FS, """
airlines AS (SELECT * FROM (VALUES ('DLH', 'Lufthansa', 'LH'), ('AAL', 'American Airlines', 'AA'),
                                   ('XX', 'Example Air', 'XX')) AS t(prefix, name, iata))""") + """
SELECT f.event_id, f.icao24, f.callsign,
       CASE WHEN a3.prefix IS NOT NULL THEN a3.name ELSE a2.name END AS airline_name,
       CASE WHEN a3.prefix IS NOT NULL THEN a3.iata ELSE a2.iata END AS airline_iata
FROM fs f
LEFT JOIN airlines a3 ON substring(upper(regexp_replace(f.callsign, '^\\s+|\\s+$', '', 'g')), 1, 3) = a3.prefix
LEFT JOIN airlines a2 ON substring(upper(regexp_replace(f.callsign, '^\\s+|\\s+$', '', 'g')), 1, 2) = a2.prefix"""


@register("airline_lookup", _AIRLINE_SQL)
def airline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = history(spark, sf_dir).select("event_id", "icao24", "callsign")
    return D.airline_lookup(fs, S.airlines_sample(spark))


@register("airline_file_lookup", _AIRLINE_SQL)
def airline_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the airlines in a file of the user's, keys in any case."""
    path = shared_dir(spark, "airlines")
    S.airlines_sample(spark).select(F.concat(F.lit(" "), F.lower("prefix")).alias("prefix"), "name", "iata").write.option("header", "true").csv(path)
    fs = history(spark, sf_dir).select("event_id", "icao24", "callsign")
    return D.airline_lookup(fs, D.read_dimension(spark, path, D.AIRLINE_SCHEMA))


# ---------------------------------------------------------------- J5 S9
@register("aircraft_dim_join", with_ctes(FS, DIM, """
lt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rk FROM fs)
       WHERE rk = 1)""") + """
SELECT lt.icao24, lt.callsign, d.registration, d.model, d.airline FROM lt LEFT JOIN dim d ON lt.icao24 = d.icao24""")
def aircraft_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt = L.latest_per_key(history(spark, sf_dir).select("icao24", "callsign", "time", "event_id"),
                          "icao24", ("time", "event_id"))
    dim = S.aircraft_dim(table(spark, sf_dir, "events"))
    return D.enrich_aircraft(lt, dim).select("icao24", "callsign", "registration", "model", "airline")


# ---------------------------------------------------------------- P13 L4
@register("search_exact", with_ctes(SEARCHES, *_SNAP, """
sq AS (SELECT query, upper(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) AS q FROM searches),
keys AS (SELECT icao24, upper(regexp_replace(callsign, '^\\s+|\\s+$', '', 'g')) AS k FROM snap
         UNION ALL SELECT icao24, upper(icao24) FROM snap)""") + """
SELECT sq.query, min(keys.icao24) AS icao24 FROM sq LEFT JOIN keys ON sq.q = keys.k
WHERE sq.q <> '' GROUP BY sq.query""")
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search_exact(searches(spark, sf_dir), snap(spark, sf_dir))


# ---------------------------------------------------------------- P14 L4
@register("search_prefix", with_ctes(SEARCHES, *_SNAP, """
hits AS (
  SELECT DISTINCT q.query, s.icao24 FROM searches q JOIN snap s
    ON starts_with(upper(regexp_replace(s.callsign, '^\\s+|\\s+$', '', 'g')), upper(q.query))
    OR starts_with(upper(s.icao24), upper(q.query))
  WHERE length(regexp_replace(q.query, '^\\s+|\\s+$', '', 'g')) >= 2)""") + """
SELECT query, icao24, rank FROM (
  SELECT query, icao24, CAST(ROW_NUMBER() OVER (PARTITION BY query ORDER BY icao24) AS BIGINT) AS rank FROM hits)
WHERE rank <= 6""")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search_prefix(searches(spark, sf_dir), snap(spark, sf_dir))


# ---------------------------------------------------------------- P10
@register("lod_aircraft", with_ctes(*_SNAP) + "\nSELECT icao24, on_ground FROM snap WHERE NOT COALESCE(on_ground, FALSE)")
def lod_aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.lod_aircraft(snap(spark, sf_dir), zoom=4).select("icao24", "on_ground")


# ---------------------------------------------------------------- P12
@register("lod_airports", """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') AS iata, CAST(s_suppkey % 3 + 1 AS INTEGER) AS tier,
       CASE WHEN s_suppkey % 3 + 1 = 1 THEN 3 WHEN s_suppkey % 3 + 1 <= 2 THEN 5 ELSE 7 END AS min_zoom
FROM supplier WHERE (CASE WHEN s_suppkey % 3 + 1 = 1 THEN 3 WHEN s_suppkey % 3 + 1 <= 2 THEN 5 ELSE 7 END) <= 5""")
def lod_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = S.airports(table(spark, sf_dir, "supplier"))
    return K.lod_airports(ap, zoom=5).select("iata", "tier", "min_zoom")


# ---------------------------------------------------------------- F13 A8
@register("category_class_counts", with_ctes(FS) + """
SELECT CASE category WHEN 'A7' THEN 'helicopter' WHEN 'B2' THEN 'balloon' WHEN 'B1' THEN 'glider'
                     WHEN 'B6' THEN 'drone' ELSE 'plane' END AS icon_class, CAST(count(*) AS BIGINT) AS n
FROM fs GROUP BY 1""")
def category_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.class_counts(history(spark, sf_dir))
