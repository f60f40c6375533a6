"""Trails and flight paths: W1 W2 W3 W4 W5 A3 A4 J9 L1 L2 L3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.phase import CRUISE, GROUND
from contrail.functions.time import ntz
from contrail.operators.latest import since, with_position, within_window
from contrail.operators.ordered import top_n_per_key, with_previous

TIME_ORDER = ("time", "event_id")


def hourly(col: str = "time") -> Column:
    """Default bucket for ordered work within a key; rows without a time come first."""
    return F.coalesce(F.date_trunc("hour", F.col(col)), F.lit("0001-01-01").cast("timestamp_ntz"))


def recent_trail_points(history: DataFrame, as_of, span: str = "15 minutes", n: int = 15,
                        tie: str = "event_id", ordered: bool = True) -> DataFrame:
    """W1 + P9 + L1: the newest ``n`` positioned rows per aircraft within
    ``span``; ``rn`` counts from the newest, output oldest first per key."""
    pts = with_position(within_window(history, as_of, span))
    ranked = top_n_per_key(pts, ["icao24"], [F.col("time").desc(), F.col(tie).desc()], n)
    out = ranked.select(
        "icao24", "time", F.col(tie),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        "flight_phase", F.col("rn").cast("bigint").alias("rn"),
    )
    return out.orderBy("icao24", F.col("rn").desc()) if ordered else out


def trail_paths(points: DataFrame, min_points: int = 2) -> DataFrame:
    """A3: one row per aircraft: ``path`` = [lon, lat] pairs oldest first,
    ``phase`` of the newest point; paths with fewer than ``min_points`` are
    dropped. Input is bounded per key (the output of W1)."""
    pts = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("k"), "lon", "lat")))
    return (
        points.groupBy("icao24")
        .agg(pts.alias("_p"), F.min_by("flight_phase", "rn").alias("phase"))
        .select("icao24", F.transform("_p", lambda x: F.array(x["lon"], x["lat"])).alias("path"), "phase")
        .filter(F.size("path") >= min_points)
    )


def path_summary(paths: DataFrame) -> DataFrame:
    """Flat view of nested paths (first/last point, length)."""
    return paths.select(
        "icao24", "phase",
        F.size("path").cast("bigint").alias("n_points"),
        F.col("path")[0][0].alias("first_lon"), F.col("path")[0][1].alias("first_lat"),
        F.element_at("path", -1)[0].alias("last_lon"), F.element_at("path", -1)[1].alias("last_lat"),
    )


def phase_transitions(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Previous phase of every row, per aircraft in time order."""
    return with_previous(history, ["icao24"], TIME_ORDER, ["flight_phase"], hourly() if bucket is None else bucket)


def last_takeoff(history: DataFrame, as_of, lookback: str = "48 hours", bucket: Column | None = None) -> DataFrame:
    """W3 + L3: per aircraft, the newest row within ``lookback`` whose phase is
    not GROUND and whose predecessor (inside the look-back) is GROUND or
    null. The first row of the look-back counts when airborne."""
    win = within_window(history, as_of, lookback).select("icao24", "time", "event_id", "flight_phase")
    tr = phase_transitions(win, bucket)
    cond = (F.col("flight_phase") != GROUND) & (
        (F.col("prev_flight_phase") == GROUND) | F.col("prev_flight_phase").isNull())
    return tr.filter(cond).groupBy("icao24").agg(F.max("time").alias("takeoff_time"))


def full_flight_points(history: DataFrame, as_of, lookback: str = "48 hours", default_span: str = "24 hours",
                       bucket: Column | None = None, ordered: bool = False) -> DataFrame:
    """S5 + J9 + L2: positioned rows since the last take-off, else since
    ``as_of - default_span``, for every aircraft at once.

    Both bounds lie within the longer of the two spans (a take-off is found
    inside the look-back), so the scan is limited to that before the join —
    the filter reaches the parquet scan.
    """
    takeoffs = last_takeoff(history, as_of, lookback, bucket)
    start = F.least(*[ntz(as_of) - F.expr(f"INTERVAL {span}") for span in (lookback, default_span)])
    pts = with_position(since(history, start))
    lower = F.coalesce(F.col("takeoff_time"), ntz(as_of) - F.expr(f"INTERVAL {default_span}"))
    out = (
        pts.join(takeoffs, "icao24", "left")
        .filter(F.col("time") >= lower)
        .select("icao24", "time", "event_id", F.col("latitude").alias("lat"),
                F.col("longitude").alias("lon"), "flight_phase")
    )
    return out.orderBy("icao24", "time", "event_id") if ordered else out


def full_flight_summary(history: DataFrame, points: DataFrame, as_of, lookback: str = "48 hours") -> DataFrame:
    """A4 (flat): per aircraft seen in the look-back: number of points, phase
    of the newest point (CRUISE when there is none), first and last point.
    Aggregates only — no per-key list is gathered."""
    keys = within_window(history, as_of, lookback).select("icao24").distinct()
    agg = points.groupBy("icao24").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max_by("flight_phase", F.struct("time", "event_id")).alias("phase"),
        F.min_by(F.struct("lon", "lat"), F.struct("time", "event_id")).alias("_first"),
        F.max_by(F.struct("lon", "lat"), F.struct("time", "event_id")).alias("_last"),
    )
    return keys.join(agg, "icao24", "left").select(
        "icao24",
        F.coalesce("n_points", F.lit(0)).cast("bigint").alias("n_points"),
        F.coalesce("phase", F.lit(CRUISE)).alias("phase"),
        F.col("_first.lon").alias("first_lon"), F.col("_first.lat").alias("first_lat"),
        F.col("_last.lon").alias("last_lon"), F.col("_last.lat").alias("last_lat"),
    )


def path_pieces(points: DataFrame, bucket: Column | None = None, max_points: int = 1000) -> DataFrame:
    """A4 (nested): the path as ordered [lon, lat] arrays in pieces of at most
    ``max_points`` points: one row per (aircraft, time bucket, chunk), so no
    row — and no task — ever holds a whole history. Concatenating the pieces
    in (piece_start, chunk) order gives the full path."""
    from pyspark.sql import Window

    b = bucket if bucket is not None else hourly()
    w = Window.partitionBy("icao24", "piece_start").orderBy("time", "event_id")
    numbered = points.withColumn("piece_start", b).withColumn(
        "chunk", F.floor((F.row_number().over(w) - 1) / F.lit(max_points)).cast("bigint"))
    pts = F.array_sort(F.collect_list(F.struct("time", "event_id", "lon", "lat")))
    return (
        numbered.groupBy("icao24", "piece_start", "chunk")
        .agg(pts.alias("_p"))
        .select("icao24", "piece_start", "chunk",
                F.transform("_p", lambda x: F.array(x["lon"], x["lat"])).alias("path"))
    )


def flight_events(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """TAKEOFF on GROUND -> other, LANDING on other -> GROUND."""
    tr = phase_transitions(history.select("icao24", "time", "event_id", "flight_phase", "latitude", "longitude"), bucket)
    prev, cur = F.col("prev_flight_phase"), F.col("flight_phase")
    kind = (F.when((prev == GROUND) & (cur != GROUND), F.lit("TAKEOFF"))
            .when((prev != GROUND) & (cur == GROUND), F.lit("LANDING")))
    return tr.select(
        "icao24", kind.alias("event_type"), F.col("time").alias("event_time"), "event_id",
        "latitude", "longitude",
    ).filter(F.col("event_type").isNotNull())


def rolling_trail_end_state(observations: DataFrame, n: int = 20, order: tuple = ("offset",)) -> DataFrame:
    """W5 at rest: the last ``n`` positioned observations per aircraft in
    arrival order (repeats kept). ``rn`` = 1 is the newest."""
    pts = with_position(observations)
    ranked = top_n_per_key(pts, ["icao24"], [F.col(o).desc() for o in order], n)
    return ranked.select("icao24", F.col("rn").cast("bigint").alias("rn"),
                         F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))


def full_flight_for(history: DataFrame, icao24: str, as_of, lookback: str = "48 hours",
                    default_span: str = "24 hours") -> DataFrame:
    """The full-flight question for one aircraft. The key predicate
    ``icao24 = lower(id)`` is applied first, so it reaches the scan (row-group
    statistics on files sorted by (icao24, time))."""
    one = history.filter(F.col("icao24") == F.lower(F.lit(icao24)))
    return full_flight_points(one, as_of, lookback, default_span, ordered=True)


def full_flight_document(points: DataFrame, icao24: str, max_points: int = 1000) -> DataFrame:
    """A4 for one aircraft: ``{icao24, path, phase}`` as ordered pieces of at
    most ``max_points`` points (see ``path_pieces``); ``phase`` is that of the
    newest point on every piece. No points: one row with an empty path and
    phase CRUISE."""
    phase = points.agg(F.max_by("flight_phase", F.struct("time", "event_id")).alias("p")).select(
        F.coalesce("p", F.lit(CRUISE)).alias("phase"))
    pieces = path_pieces(points, max_points=max_points).drop("icao24")
    empty = phase.select(F.lit(None).cast("timestamp_ntz").alias("piece_start"), F.lit(0).cast("bigint").alias("chunk"),
                         F.array().cast("array<array<double>>").alias("path"), "phase").filter(~points.exists())
    # the phase is a one-row table: attach it as a scalar
    with_phase = pieces.withColumn("phase", phase.select("phase").scalar())
    return with_phase.unionByName(empty).select(F.lit(icao24).alias("icao24"), "piece_start", "chunk", "path", "phase")


def rolling_trail_rows(observations: DataFrame, n: int = 20, order: tuple = ("offset",),
                       bucket: Column | None = None) -> DataFrame:
    """W5 per row: for every positioned observation, the trail of the last
    ``n`` observations of its aircraft up to and including it.

    Split per (aircraft, bucket) like contrail.operators.ordered: inside a
    bucket a bounded window; across buckets only the last ``n - 1`` points of
    each earlier bucket are carried (a table of keys x buckets, each entry
    bounded by ``n``). Without a ``bucket`` an aircraft is one window: give
    one, monotone in ``order``, wherever an aircraft may hold many rows.
    """
    from pyspark.sql import Window

    pts = with_position(observations).select(
        "icao24", *order, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    o = [F.col(c) for c in order]
    pt = F.struct(*[F.col(c) for c in order], "lon", "lat")
    if bucket is None:
        w = Window.partitionBy("icao24").orderBy(*o).rowsBetween(-(n - 1), 0)
        trail = F.collect_list(pt).over(w)
        return pts.select("icao24", *order, F.transform(trail, lambda x: F.array(x["lon"], x["lat"])).alias("trail"))

    b = pts.withColumn("_b", bucket)
    w = Window.partitionBy("icao24", "_b").orderBy(*o).rowsBetween(-(n - 1), 0)
    inner = b.withColumn("_in", F.collect_list(pt).over(w))
    tails = (top_n_per_key(b, ["icao24", "_b"], [c.desc() for c in o], n - 1, "_r")
             .groupBy("icao24", "_b").agg(F.array_sort(F.collect_list(pt)).alias("_tail")))
    wb = Window.partitionBy("icao24").orderBy("_b").rowsBetween(-(n - 1), -1)
    carry = tails.select("icao24", "_b", F.flatten(F.collect_list("_tail").over(wb)).alias("_carry"))
    j = inner.join(carry, ["icao24", "_b"], "left")
    full = F.concat(F.coalesce(F.col("_carry"), F.array().cast(inner.schema["_in"].dataType)), F.col("_in"))
    last_n = F.slice(full, F.greatest(F.size(full) - F.lit(n - 1), F.lit(1)), n)
    return j.select("icao24", *order, F.transform(last_n, lambda x: F.array(x["lon"], x["lat"])).alias("trail"))
