"""Registered queries: route pick, projection, cache validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.time import ntz
from contrail.operators import routes as R
from contrail.plans import params as P
from contrail.plans.oracle_ctes import CAND, with_ctes
from contrail.plans.registry import register
from contrail.sources.standins import route_candidates
from contrail.sources.tables import table


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_candidates(table(spark, sf_dir, "orders"), P.AS_OF)


def routes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored routes, one per callsign, stamped when cached."""
    best = R.pick_route(candidates(spark, sf_dir))
    cached = ntz(P.AS_OF) - F.make_dt_interval(hours=((F.col("pos") * 7) % 24).cast("int")) - F.expr("INTERVAL 30 MINUTES")
    return R.project_route(best, keep=("pos",)).withColumn("cached_at", cached).drop("pos")


def cached_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.valid_routes(routes_table(spark, sf_dir), P.AS_OF, P.ROUTE_TTL)


# ---------------------------------------------------------------- S6 A5
@register("route_pick", with_ctes(CAND) + "\nSELECT callsign, pos, priority, has_origin AS valid FROM best")
def route_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pick_route(candidates(spark, sf_dir)).select("callsign", "pos", "priority", "valid")


# ---------------------------------------------------------------- F12
_ROUTE_COLS = ["callsign", "aircraft_type", "flight_number", "status", "departure_delay", "arrival_delay",
               "route_distance", "estimated_on", "actual_on", "scheduled_on", "fa_flight_id",
               "origin_iata_code", "origin_municipality", "origin_name",
               "destination_iata_code", "destination_municipality", "destination_name"]


@register("route_projection", with_ctes(CAND) + f"\nSELECT {', '.join(_ROUTE_COLS)} FROM routes")
def route_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flatten_route(R.project_route(R.pick_route(candidates(spark, sf_dir)))).select(*_ROUTE_COLS)


# ---------------------------------------------------------------- K10 T5
@register("routes_valid", with_ctes(CAND) + """
SELECT callsign, flight_number, cached_at, cached_at + INTERVAL 12 HOUR AS expires_at FROM valid_routes""")
def routes_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached_routes(spark, sf_dir).select("callsign", "flight_number", "cached_at", "expires_at")
