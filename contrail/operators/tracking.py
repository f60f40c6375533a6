"""Tracked list, search, level of detail: A11 J4 J6 J7 J8 P10-P14 A8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.display import category_class
from contrail.functions.numeric import strip_ws
from contrail.operators.latest import latest_per_key
from contrail.operators.ordered import top_n_per_key


def distinct_tracked(actions: DataFrame) -> DataFrame:
    """Replay of track/untrack actions (``seq``, ``action``, ``icao24``).

    Adding an id already in the list keeps its first position; removing
    drops it; adding again after a removal appends it anew. Per id: the
    first add after the last removal — one grouped aggregate, no ordering
    of the whole log.
    """
    last_rm = F.max(F.when(F.col("action") == "untrack", F.col("seq")))
    per_id = actions.groupBy("icao24").agg(last_rm.alias("_rm"))
    adds = actions.filter(F.col("action") == "track").join(per_id.select("icao24", "_rm"), "icao24")
    return (adds.filter(F.col("_rm").isNull() | (F.col("seq") > F.col("_rm")))
            .groupBy("icao24").agg(F.min("seq").alias("position")))


def tracked_with_snapshot(tracked: DataFrame, snap: DataFrame, phase_default: str = "CRUISE") -> DataFrame:
    """The tracked list left-joined to the snapshot; unknown ids stay
    (with nulls), phase defaults to CRUISE, list order kept."""
    s = snap.select("icao24", "callsign", "lat", "lon", "altitude", "flight_phase")
    return (tracked.join(s, "icao24", "left")
            .withColumn("flight_phase", F.coalesce("flight_phase", F.lit(phase_default)))
            .orderBy("position"))


def metadata_of_tracked(meta: DataFrame, tracked: DataFrame) -> DataFrame:
    """Keep metadata rows of tracked ids only."""
    return meta.join(tracked.select("icao24"), "icao24", "left_semi")


def tracked_without_metadata(tracked: DataFrame, snap: DataFrame, meta: DataFrame) -> DataFrame:
    """Tracked ids with a non-blank live callsign and no metadata yet."""
    live = snap.select("icao24", strip_ws(F.col("callsign")).alias("callsign")).filter(
        F.col("callsign").isNotNull() & (F.col("callsign") != ""))
    return (tracked.join(live, "icao24", "inner")
            .join(meta.select("icao24"), "icao24", "left_anti")
            .select("icao24", "position", "callsign"))


def tracked_alert_emails(tracked: DataFrame, subs: DataFrame) -> DataFrame:
    """The stored alert e-mail per tracked id (last one wins), or null."""
    last = latest_per_key(subs.select("icao24", "email", "created_at"), "icao24", ("created_at", "email"))
    return tracked.join(last.select("icao24", "email"), "icao24", "left").select("icao24", "position", "email")


def _norm_query_exact(q: Column) -> Column:
    return F.upper(strip_ws(q))


def search_exact(searches: DataFrame, snap: DataFrame) -> DataFrame:
    """P13 + L4: per search text, the first aircraft (by id) whose trimmed
    upper callsign or upper id equals the trimmed upper text; null if none.
    Two equi-joins instead of one OR-join (which would be a nested loop)."""
    q = searches.select("query", _norm_query_exact(F.col("query")).alias("_q")).filter(F.col("_q") != "")
    by_cs = snap.select("icao24", F.upper(strip_ws(F.col("callsign"))).alias("_k"))
    by_id = snap.select("icao24", F.upper(F.col("icao24")).alias("_k"))
    keys = by_cs.unionByName(by_id).filter(F.col("_k").isNotNull())
    hits = q.join(keys, q["_q"] == keys["_k"], "inner").groupBy("query").agg(F.min("icao24").alias("icao24"))
    return q.select("query").join(hits, "query", "left")


def search_prefix(searches: DataFrame, snap: DataFrame, limit: int = 6, min_chars: int = 2) -> DataFrame:
    """P14 + L4: suggestions — aircraft whose trimmed upper callsign or upper
    id starts with the upper-cased (untrimmed) text; texts with fewer than
    ``min_chars`` non-blank characters get none; at most ``limit`` per text,
    by id.

    Every aircraft emits the prefixes of its two keys (bounded by key
    length). Those that some text asks for stay (a semi-join with the distinct
    texts), the first ``limit`` aircraft of each prefix are kept as a window
    group limit, and only these meet the texts.
    """
    q = searches.filter(F.length(strip_ws(F.col("query"))) >= min_chars).select(
        "query", F.upper(F.col("query")).alias("_q"))
    keys = snap.select("icao24", F.explode(F.array(
        F.upper(strip_ws(F.col("callsign"))), F.upper(F.col("icao24")))).alias("_k")).filter(F.col("_k").isNotNull())
    prefixes = keys.select(
        "icao24",
        F.explode(F.transform(F.sequence(F.lit(min_chars), F.greatest(F.length("_k"), F.lit(min_chars))),
                              lambda i: F.substring(F.col("_k"), 1, i))).alias("_p"),
    ).distinct()
    asked = prefixes.join(q.select(F.col("_q").alias("_p")).distinct(), "_p", "left_semi")
    first = top_n_per_key(asked, ["_p"], [F.col("icao24")], limit, "rank")
    return q.join(first, q["_q"] == first["_p"]).select("query", "icao24", F.col("rank").cast("bigint").alias("rank"))


def lod_aircraft(snap: DataFrame, zoom: float) -> DataFrame:
    """P10: at zoom <= 4 aircraft on the ground are hidden."""
    return snap.filter(F.lit(zoom > 4) | ~F.coalesce(F.col("on_ground"), F.lit(False)))


def airport_min_zoom(tier: Column) -> Column:
    """Tier 1 from zoom 3, tier 2 from zoom 5, others from zoom 7."""
    return F.when(tier == 1, F.lit(3)).when(tier <= 2, F.lit(5)).otherwise(F.lit(7))


def lod_airports(airports: DataFrame, zoom: float) -> DataFrame:
    return airports.withColumn("min_zoom", airport_min_zoom(F.col("tier"))).filter(F.col("min_zoom") <= F.lit(zoom))


def class_counts(df: DataFrame) -> DataFrame:
    """F13 + A8: rows per icon class."""
    return df.groupBy(category_class(F.col("category")).alias("icon_class")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
