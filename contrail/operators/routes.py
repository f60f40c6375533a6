"""Routes: S6 A5 F12 K10 (T5 for the cache expiry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from contrail.functions.numeric import strip_ws
from contrail.functions.text import blank_to_null, first_non_empty
from contrail.functions.time import ntz
from contrail.operators.latest import latest_per_key
from contrail.operators.ordered import top_n_per_key

_AIRPORT = StructType([StructField(n, StringType()) for n in ("code_iata", "code", "city", "name")])
CANDIDATE_SCHEMA = StructType([
    StructField("callsign", StringType()),
    StructField("flights", ArrayType(StructType([
        StructField("actual_off", StringType()), StructField("actual_on", StringType()),
        StructField("estimated_on", StringType()), StructField("scheduled_on", StringType()),
        StructField("status", StringType()), StructField("origin", _AIRPORT), StructField("destination", _AIRPORT),
        StructField("departure_delay", StringType()), StructField("arrival_delay", StringType()),
        StructField("aircraft_type", StringType()), StructField("ident_iata", StringType()),
        StructField("ident", StringType()), StructField("route_distance", StringType()),
        StructField("fa_flight_id", StringType()),
    ]))),
])


def candidate_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed route documents ``{callsign, flights: [...]}`` -> one row per
    candidate; ``pos`` keeps the document order ("first" matters)."""
    docs = spark.read.schema(CANDIDATE_SCHEMA).json(path)
    flat = docs.select("callsign", F.posexplode_outer("flights").alias("pos", "f")).filter(F.col("f").isNotNull())
    f = F.col("f")
    return flat.select(
        strip_ws(F.col("callsign")).alias("callsign"), F.col("pos").cast("bigint").alias("pos"),
        *[f[n].alias(n) for n in ("actual_off", "actual_on", "estimated_on", "scheduled_on", "status",
                                  "origin", "destination")],
        f["departure_delay"].try_cast("int").alias("departure_delay"),
        f["arrival_delay"].try_cast("int").alias("arrival_delay"),
        f["aircraft_type"].alias("aircraft_type"), f["ident_iata"].alias("ident_iata"), f["ident"].alias("ident"),
        f["route_distance"].try_cast("int").alias("route_distance"), f["fa_flight_id"].alias("fa_flight_id"),
    )


def route_priority() -> Column:
    """A5 classes: 1 departed and not landed; 2 status says En Route; 3 departed."""
    off, on = blank_to_null(F.col("actual_off")), blank_to_null(F.col("actual_on"))
    return (
        F.when(off.isNotNull() & on.isNull(), F.lit(1))
        .when(F.coalesce(F.col("status").contains("En Route"), F.lit(False)), F.lit(2))
        .when(off.isNotNull(), F.lit(3))
    )


def pick_route(candidates: DataFrame, key: str = "callsign") -> DataFrame:
    """A5: the best candidate per callsign.

    Lowest class wins; in classes 1 and 2 the first candidate, in class 3 the
    greatest ``actual_off`` (text order), first on ties. ``row_number() = 1``
    under that order: planned with a partial window group limit before the
    shuffle, so a callsign with millions of candidates forwards one row per
    map task. ``valid`` is false when origin or destination is missing (no
    route).
    """
    c = candidates.withColumn("priority", route_priority()).filter(F.col("priority").isNotNull())
    order = [
        F.col("priority").asc(),
        F.when(F.col("priority") == 3, F.col("actual_off")).desc_nulls_last(),
        F.col("pos").asc(),
    ]
    best = top_n_per_key(c, [key], order, 1, "_rk").drop("_rk")
    return best.withColumn("valid", F.col("origin").isNotNull() & F.col("destination").isNotNull())


def _airport(a: str) -> Column:
    return F.struct(
        F.coalesce(blank_to_null(F.col(f"{a}.code_iata")), F.col(f"{a}.code"), F.lit("")).alias("iata_code"),
        F.coalesce(F.col(f"{a}.city"), F.lit("")).alias("municipality"),
        F.coalesce(F.col(f"{a}.name"), F.lit("")).alias("name"),
    )


def project_route(best: DataFrame, keep: tuple = ()) -> DataFrame:
    """the stored route record of a valid pick (``keep``: extra columns)."""
    return best.filter("valid").select(
        "callsign", *keep,
        _airport("origin").alias("origin"),
        _airport("destination").alias("destination"),
        "aircraft_type",
        F.coalesce(blank_to_null(F.col("ident_iata")), F.col("ident")).alias("flight_number"),
        "status",
        F.coalesce("departure_delay", F.lit(0)).alias("departure_delay"),
        F.coalesce("arrival_delay", F.lit(0)).alias("arrival_delay"),
        "route_distance", "estimated_on", "actual_on", "scheduled_on", "fa_flight_id",
    )


def flatten_route(routes: DataFrame) -> DataFrame:
    nested = ("origin", "destination")
    flat = [c for c in routes.columns if c not in nested]
    return routes.select(
        *flat,
        *[F.col(f"{a}.{f}").alias(f"{a}_{f}") for a in nested for f in ("iata_code", "municipality", "name")],
    )


def upsert_routes(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """key = trimmed callsign (case kept); the newest ``cached_at`` wins."""
    return latest_per_key(existing.unionByName(fresh), "callsign", ("cached_at",))


def valid_routes(routes: DataFrame, as_of, ttl: str = "12 hours") -> DataFrame:
    """T5: a cached route lives ``ttl`` after ``cached_at``."""
    return routes.filter(F.col("cached_at") > ntz(as_of) - F.expr(f"INTERVAL {ttl}")).withColumn(
        "expires_at", F.col("cached_at") + F.expr(f"INTERVAL {ttl}"))


def alert_eta(routes: DataFrame) -> Column:
    return first_non_empty(F.col("estimated_on"), F.col("scheduled_on"))
