"""Ingest clean-up: S2 P1 P2 P3 A9 (F1-F6 applied as column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions import numeric as N
from contrail.functions.geo import covering_circle
from contrail.functions.text import clean_callsign, clean_icao24
from contrail.functions.time import iso_text, ntz
from contrail.schema import RAW_POLL_SCHEMA

STATE_OUT = ["icao24", "callsign", "latitude", "longitude", "baro_altitude", "geo_altitude", "on_ground",
             "velocity", "true_track", "vertical_rate", "squawk", "category"]


def raw_poll_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed poll responses (one JSON document per file) -> one row per
    aircraft object. A missing or null ``ac`` array yields no rows."""
    reader = spark.readStream if stream else spark.read
    docs = reader.option("wholetext", "true").text(path)
    parsed = docs.select(F.from_json("value", RAW_POLL_SCHEMA).alias("d"))
    return parsed.select(F.explode("d.ac").alias("ac")).select("ac.*")


def normalise(raw: DataFrame, keep: tuple = ("event_id",), as_of=None) -> DataFrame:
    """Map raw aircraft objects to state rows plus a ``reject_reason``.

    Rejected (reason set): blank/missing hex; latitude or longitude missing
    or unparseable; ``alt_baro`` present, not "ground" and not a number.
    Other unparseable numbers only become null. Units: ft -> m, kt -> m/s,
    ft/min -> m/s. NaN and infinity come out as null (their JSON form).

    Two projections: every raw field is parsed exactly once in the first;
    the second only combines parsed values (Catalyst keeps them apart because
    the parsed values are referenced several times).
    """
    keep = [c for c in keep if c in raw.columns]
    alt_raw = F.col("alt_baro")
    parsed = raw.select(
        *keep,
        clean_icao24(F.col("hex")).alias("icao24"),
        clean_callsign(F.col("flight")).alias("callsign"),
        N.safe_number(F.col("lat")).alias("_lat"),
        N.safe_number(F.col("lon")).alias("_lon"),
        F.coalesce(alt_raw == F.lit("ground"), F.lit(False)).alias("on_ground"),
        alt_raw.isNotNull().alias("_alt_present"),
        N.safe_number(alt_raw).alias("_alt"),
        N.safe_number(F.col("alt_geom")).alias("_geo"),
        N.safe_number(F.col("gs")).alias("_gs"),
        N.safe_number(F.col("track")).alias("_track"),
        N.safe_number(F.col("baro_rate")).alias("_rate"),
        F.col("squawk"),
        F.col("category"),
    )
    lat, lon, og = F.col("_lat"), F.col("_lon"), F.col("on_ground")
    reason = (
        F.when(F.col("icao24").isNull(), F.lit("missing_hex"))
        .when(lat.isNull() | lon.isNull(), F.lit("bad_position"))
        .when(F.col("_alt_present") & ~og & F.col("_alt").isNull(), F.lit("bad_alt_baro"))
    )
    out = parsed.select(
        *keep,
        "icao24", "callsign",
        N.finite_or_null(lat).alias("latitude"),
        N.finite_or_null(lon).alias("longitude"),
        F.when(~og, N.finite_or_null(F.col("_alt") * F.lit(N.FT_TO_M))).alias("baro_altitude"),
        N.finite_or_null(F.col("_geo") * F.lit(N.FT_TO_M)).alias("geo_altitude"),
        og.alias("on_ground"),
        N.finite_or_null(F.col("_gs") * F.lit(N.KT_TO_MS)).alias("velocity"),
        N.finite_or_null(F.col("_track")).alias("true_track"),
        N.finite_or_null(F.col("_rate") * F.lit(N.FTMIN_TO_MS)).alias("vertical_rate"),
        "squawk", "category",
        reason.alias("reject_reason"),
        # raw coordinates before NaN->null, for the box test (NaN is outside)
        "_lat", "_lon",
    )
    if as_of is not None:
        out = out.withColumn("ingested_at", iso_text(ntz(as_of)))
    return out


def accepted(norm: DataFrame) -> DataFrame:
    """Rows without a reject reason. Selected with a generator rather than a
    filter: a filter would be pushed below the parsing projection and parse
    every field a second time."""
    cols = [c for c in norm.columns if c not in ("reject_reason", "_lat", "_lon")]
    one = F.array(F.struct(*[F.col(c) for c in cols]))
    return norm.select(F.inline(F.when(F.col("reject_reason").isNull(), one)))


def within_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; null or NaN coordinate -> false."""
    min_lat, max_lat, min_lon, max_lon = box
    ok = (lat.between(F.lit(min_lat), F.lit(max_lat)) & lon.between(F.lit(min_lon), F.lit(max_lon))
          & ~F.isnan(lat) & ~F.isnan(lon))
    return F.coalesce(ok, F.lit(False))


def publish_outcome(norm: DataFrame, box: tuple[float, float, float, float]) -> Column:
    """A9 per row: the reject reason, ``outside_box``, or ``published``."""
    inside = within_box(F.col("_lat"), F.col("_lon"), box)
    return F.coalesce(F.col("reject_reason"), F.when(~inside, F.lit("outside_box")), F.lit("published"))


def ingest_counters(norm: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows per outcome (published / each reject reason / outside box)."""
    return norm.groupBy(publish_outcome(norm, box).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def observe_counters(norm: DataFrame, box: tuple[float, float, float, float], observation="ingest"):
    """A9 without an extra pass: the counters as ``DataFrame.observe``
    metrics, collected while the data flows to its sink. ``observation`` is
    a name (streaming: reported in query progress) or a
    ``pyspark.sql.Observation`` (batch)."""
    o = publish_outcome(norm, box)
    return norm.observe(
        observation,
        F.count(F.when(o == "published", 1)).alias("published"),
        F.count(F.when(o != "published", 1)).alias("skipped"),
    )


def covering_circles(boxes: DataFrame) -> DataFrame:
    """P3 over a table of boxes (min_lat, max_lat, min_lon, max_lon)."""
    c = covering_circle(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    return boxes.select("*", c.alias("_c")).select(*boxes.columns, "_c.*")
