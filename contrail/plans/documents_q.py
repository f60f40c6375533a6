"""Registered queries: nested documents, compared point by point, and landed
JSON read back through its own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.time import ntz
from contrail.operators import clean as C
from contrail.operators import latest as L
from contrail.operators import routes as R
from contrail.operators import trails as T
from contrail.plans import params as P
from contrail.plans.oracle_ctes import AS_OF_SQL, CAND, FS, RAW, with_ctes
from contrail.plans.registry import register
from contrail.plans.routes_q import candidates, routes_table
from contrail.plans.snapshot_q import _snapshot, _snapshot_sql
from contrail.plans.trails_q import _FULL_POINTS_CTE, _TAKEOFF_CTE, history
from contrail.schema import RAW_AIRCRAFT_FIELDS
from contrail.session import shared_dir
from contrail.sources.standins import raw_aircraft
from contrail.sources.tables import table

POLL_ROWS = 500  # aircraft per landed poll response


def _points(paths: DataFrame, *keys: str) -> DataFrame:
    """One row per point of a ``path`` array, with its place."""
    out = paths.select(*keys, F.posexplode("path").alias("pos", "p"))
    return out.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


# ---------------------------------------------------------------- A3
@register("trail_path_points", with_ctes(FS, f"""
ranked AS (
  SELECT icao24, latitude AS lat, longitude AS lon,
         ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rn
  FROM fs WHERE time > {AS_OF_SQL} - INTERVAL '{P.TRAIL_SPAN}' AND latitude IS NOT NULL AND longitude IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY icao24) AS n FROM ranked WHERE rn <= {P.TRAIL_POINTS})""") + """
SELECT icao24, CAST(n - rn AS BIGINT) AS pos, lon, lat FROM sized WHERE n >= 2""")
def trail_path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = T.recent_trail_points(history(spark, sf_dir), P.AS_OF, P.TRAIL_SPAN, P.TRAIL_POINTS, ordered=False)
    return _points(T.trail_paths(pts), "icao24")


# ---------------------------------------------------------------- A4
@register("full_flight_path", with_ctes(FS, _TAKEOFF_CTE, _FULL_POINTS_CTE, """
placed AS (SELECT *, date_trunc('hour', time) AS piece_start,
                  ROW_NUMBER() OVER (PARTITION BY icao24, date_trunc('hour', time) ORDER BY time, event_id) - 1 AS k FROM pts)""") + """
SELECT icao24, piece_start, CAST(k // 3 AS BIGINT) AS chunk, CAST(k % 3 AS BIGINT) AS pos, lon, lat FROM placed""")
def full_flight_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested path of every aircraft, in pieces of three points so that
    the cut into pieces is seen."""
    pts = T.full_flight_points(history(spark, sf_dir), P.AS_OF, P.FULL_FLIGHT_LOOKBACK, P.FULL_FLIGHT_DEFAULT, bucket=T.hourly())
    return _points(T.path_pieces(pts, max_points=3), "icao24", "piece_start", "chunk")


# ---------------------------------------------------------------- S5 A4
_ONE = "000003"


@register("full_flight_one", with_ctes(FS, _TAKEOFF_CTE, _FULL_POINTS_CTE, f"""
mine AS (SELECT * FROM pts WHERE icao24 = '{_ONE}'),
placed AS (SELECT *, date_trunc('hour', time) AS piece_start,
                  ROW_NUMBER() OVER (PARTITION BY date_trunc('hour', time) ORDER BY time, event_id) - 1 AS k FROM mine)""") + """
SELECT icao24, piece_start, CAST(k // 1000 AS BIGINT) AS chunk,
       (SELECT arg_max(flight_phase, (time, event_id)) FROM mine) AS phase, CAST(k % 1000 AS BIGINT) AS pos, lon, lat FROM placed""")
def full_flight_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full path of one aircraft, asked for by its id."""
    pts = T.full_flight_for(history(spark, sf_dir), _ONE, P.AS_OF, P.FULL_FLIGHT_LOOKBACK, P.FULL_FLIGHT_DEFAULT)
    return _points(T.full_flight_document(pts, _ONE), "icao24", "piece_start", "chunk", "phase")


# ---------------------------------------------------------------- K6 P16
@register("positions_document", with_ctes(*_snapshot_sql(P.LIVE_MAX_AGE)) + "\nSELECT * FROM snap")
def positions_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paged positions document, with a heartbeat among the messages, read
    back by the operator that keeps messages of one type."""
    pages = L.positions_document(_snapshot(spark, sf_dir, P.LIVE_MAX_AGE), P.AS_OF, page_size=40).select("message")
    beat = pages.limit(1).select(F.lit('{"type":"heartbeat","aircraft":[{"icao24":"x"}]}').alias("message"))
    return L.positions_messages_only(pages.union(beat), "message").drop("timestamp")


# ---------------------------------------------------------------- S2
@register("raw_poll_json", with_ctes(RAW) + f"""
SELECT {", ".join(C.STATE_OUT)} FROM norm WHERE reject_reason IS NULL""")
def raw_poll_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll responses landed as one JSON document per file, read and cleaned."""
    path = shared_dir(spark, "polls")
    raw = raw_aircraft(table(spark, sf_dir, "events"))
    polls = raw.groupBy(F.floor(F.col("event_id") / POLL_ROWS).alias("poll")).agg(
        F.collect_list(F.struct(*RAW_AIRCRAFT_FIELDS)).alias("ac"))
    polls.select(F.to_json(F.struct("ac")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return C.accepted(C.normalise(C.raw_poll_files(spark, path), keep=())).select(*C.STATE_OUT)


# ---------------------------------------------------------------- S6
_FLIGHT = ("actual_off", "actual_on", "estimated_on", "scheduled_on", "status", "origin", "destination", "departure_delay",
           "arrival_delay", "aircraft_type", "ident_iata", "ident", "route_distance", "fa_flight_id")


@register("route_documents", with_ctes(CAND) + "\nSELECT callsign, priority, has_origin AS valid, fa_flight_id FROM best")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route documents landed as JSON, read back and picked from."""
    path = shared_dir(spark, "routes")
    flights = F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*_FLIGHT)).alias("f"))))
    docs = candidates(spark, sf_dir).groupBy("callsign").agg(flights.alias("d")).select(F.concat(
        F.lit('{"callsign":"'), "callsign", F.lit('","flights":['),
        F.array_join(F.transform("d", lambda x: x["f"]), ","), F.lit("]}")).alias("value"))
    docs.write.text(path)
    return R.pick_route(R.candidate_documents(spark, path)).select("callsign", "priority", "valid", "fa_flight_id")


# ---------------------------------------------------------------- K10
_STAMP = f"{AS_OF_SQL} - to_hours(CAST((pos * 7) % 24 AS INTEGER)) - INTERVAL 30 MINUTE"


@register("route_upsert", with_ctes(CAND) + f"""
SELECT callsign, CASE WHEN pos % 2 = 0 THEN {_STAMP} ELSE {AS_OF_SQL} - INTERVAL 100 HOUR END AS cached_at,
       CASE WHEN pos % 2 = 0 THEN 'fresh' ELSE 'stored' END AS status
FROM best WHERE has_origin""")
def route_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh routes over stored, older ones: the newest of each callsign stays."""
    routes = routes_table(spark, sf_dir)
    stored = routes.withColumn("cached_at", ntz(P.AS_OF) - F.expr("INTERVAL 100 HOURS")).withColumn("status", F.lit("stored"))
    even = F.substring_index("fa_flight_id", "-", -1).cast("bigint") % 2 == 0
    fresh = routes.filter(even).withColumn("status", F.lit("fresh"))
    return R.upsert_routes(stored, fresh).select("callsign", "cached_at", "status")
