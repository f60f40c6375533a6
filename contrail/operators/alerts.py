"""Landing alerts: S7 J2 J3 P15 F10 K7 K8 K9 T7 T8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.numeric import strip_ws
from contrail.functions.text import blank_to_null, first_non_empty
from contrail.functions.time import lenient_instant, minutes_between, ntz
from contrail.operators.latest import latest_per_key

SUB_COLS = ["email", "icao24", "callsign", "notified", "created_at", "expires_at"]


def upsert_subscriptions(requests: DataFrame, ttl: str = "24 hours", existing: DataFrame | None = None) -> DataFrame:
    """K8 + F22: key (lower id, lower e-mail); an e-mail without ``@`` is
    rejected; the latest request (``created_at``, then arrival ``seq``) wins
    and overwrites everything, ``notified`` included. Expires ``ttl`` after
    creation."""
    req = requests.filter(F.col("email").contains("@")).select(
        "email",
        F.lower("icao24").alias("icao24"),
        strip_ws(F.col("callsign")).alias("callsign"),
        F.coalesce("notified", F.lit(False)).alias("notified"),
        "created_at",
        (F.col("created_at") + F.expr(f"INTERVAL {ttl}")).alias("expires_at"),
        "seq",
        F.lower("email").alias("sub_email"),
    )
    if existing is not None:
        req = existing.withColumn("sub_email", F.lower("email")).withColumn("seq", F.lit(-1).cast("bigint")).unionByName(req)
    return latest_per_key(req, ["icao24", "sub_email"], ("created_at", "seq")).select(*SUB_COLS)


def delete_subscriptions(subs: DataFrame, deletes: DataFrame) -> DataFrame:
    """K9: remove by the same case-insensitive key; unknown keys are fine."""
    d = deletes.select(F.lower("icao24").alias("_i"), F.lower("email").alias("_e")).distinct()
    return subs.join(d, (F.col("icao24") == F.col("_i")) & (F.lower("email") == F.col("_e")), "left_anti")


def replay_subscriptions(requests: DataFrame, deletes: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """K8 + K9 as one ordered log: a delete is a tombstone at its own time
    (``created_at``, then ``seq``), so a later request subscribes again."""
    live = requests.filter(F.col("email").contains("@")).select(
        "email", F.lower("icao24").alias("icao24"), strip_ws(F.col("callsign")).alias("callsign"),
        F.coalesce("notified", F.lit(False)).alias("notified"), "created_at", "seq", F.lit(False).alias("gone"))
    gone = deletes.select("email", F.lower("icao24").alias("icao24"), F.lit(None).cast("string").alias("callsign"),
                          F.lit(False).alias("notified"), "created_at", "seq", F.lit(True).alias("gone"))
    last = latest_per_key(live.unionByName(gone).withColumn("sub_email", F.lower("email")),
                          ["icao24", "sub_email"], ("created_at", "seq"))
    return last.filter("not gone").withColumn(
        "expires_at", F.col("created_at") + F.expr(f"INTERVAL {ttl}")).select(*SUB_COLS)


def active_subscriptions(subs: DataFrame, as_of) -> DataFrame:
    """Keys that have not expired."""
    return subs.filter(F.col("expires_at") > ntz(as_of))


def resolve_callsign(subs: DataFrame, live: DataFrame) -> DataFrame:
    """A blank subscription callsign takes the live aircraft's callsign."""
    lv = live.select(F.col("icao24").alias("_li"), F.col("callsign").alias("_lcs"))
    return subs.join(lv, subs["icao24"] == lv["_li"], "left").select(
        *[subs[c] for c in subs.columns if c != "callsign"],
        F.coalesce(blank_to_null(strip_ws(subs["callsign"])), blank_to_null(strip_ws(F.col("_lcs")))).alias("callsign"),
    )


def _due(df: DataFrame, as_of, window_min: int) -> DataFrame:
    """P15 + F10 on rows that carry route fields."""
    eta = lenient_instant(first_non_empty(F.col("estimated_on"), F.col("scheduled_on")))
    mins = minutes_between(ntz(as_of), eta)
    return (
        df.filter(blank_to_null(F.col("actual_on")).isNull())
        .withColumn("eta", eta)
        .withColumn("minutes_exact", mins)
        .filter((F.col("minutes_exact") > 0) & (F.col("minutes_exact") <= float(window_min)))
    )


def due_alerts(subs: DataFrame, live: DataFrame, routes: DataFrame, as_of, window_min: int = 65,
               fired: DataFrame | None = None) -> DataFrame:
    """One alert tick. Active, not yet notified subscriptions, callsign
    resolved (J3), joined to their cached route (J2), due within the window
    (P15), not fired before (keyed by id, e-mail, creation) -> K7 records."""
    s = active_subscriptions(subs, as_of).filter(~F.col("notified"))
    s = resolve_callsign(s, live).filter(F.col("callsign").isNotNull())
    r = routes.select(
        F.col("callsign").alias("_rcs"), "flight_number", "estimated_on", "scheduled_on", "actual_on",
        F.col("origin.iata_code").alias("origin_iata"), F.col("origin.municipality").alias("origin_city"),
        F.col("destination.iata_code").alias("dest_iata"), F.col("destination.municipality").alias("dest_city"))
    j = s.join(r, s["callsign"] == r["_rcs"], "inner")
    due = _due(j, as_of, window_min)
    out = due.select(
        "email", "icao24", "callsign",
        F.coalesce(blank_to_null(F.col("flight_number")), F.col("callsign")).alias("flight_number"),
        F.coalesce("origin_iata", F.lit("???")).alias("origin_iata"),
        F.coalesce("origin_city", F.lit("")).alias("origin_city"),
        F.coalesce("dest_iata", F.lit("???")).alias("dest_iata"),
        F.coalesce("dest_city", F.lit("")).alias("dest_city"),
        F.col("minutes_exact").cast("int").alias("minutes"),
        "eta", F.date_format("eta", "HH:mm 'UTC'").alias("eta_text"), "created_at",
    )
    if fired is not None:
        out = out.join(fired.select("icao24", "email", "created_at"), ["icao24", "email", "created_at"], "left_anti")
    return out


def mark_notified(subs: DataFrame, alerts: DataFrame, as_of, min_ttl: str = "1 hour") -> DataFrame:
    """After a tick: fired subscriptions get ``notified`` and keep at least
    ``min_ttl`` to live."""
    hit = alerts.select("icao24", "email", "created_at").withColumn("_hit", F.lit(True))
    j = subs.join(hit, ["icao24", "email", "created_at"], "left")
    floor_exp = ntz(as_of) + F.expr(f"INTERVAL {min_ttl}")
    return j.select(
        "email", "icao24", "callsign",
        (F.col("notified") | F.coalesce("_hit", F.lit(False))).alias("notified"),
        "created_at",
        F.when(F.col("_hit"), F.greatest("expires_at", floor_exp)).otherwise(F.col("expires_at")).alias("expires_at"),
    )


def subscribe_immediate(requests: DataFrame, routes: DataFrame, as_of, window_min: int = 65) -> DataFrame:
    """At subscribe time, with the callsign given in the request only (no
    live fallback), fire at once when the route is already due."""
    req = requests.filter(F.col("email").contains("@")).withColumn("callsign", strip_ws(F.col("callsign")))
    r = routes.select(F.col("callsign").alias("_rcs"), "estimated_on", "scheduled_on", "actual_on")
    due = _due(req.join(r, req["callsign"] == r["_rcs"], "inner"), as_of, window_min).select(
        "seq", F.lit(True).alias("_now"))
    return req.join(due, "seq", "left").select(
        "seq", "email", F.lower("icao24").alias("icao24"), "callsign",
        F.coalesce("_now", F.lit(False)).alias("sent_immediately"))


def subscribe(requests: DataFrame, routes: DataFrame, as_of, ttl: str = "24 hours", window_min: int = 65) -> DataFrame:
    """T8 into K8: whoever is mailed at subscribe time is stored as notified,
    so the next tick (T7) does not mail again."""
    sent = subscribe_immediate(requests, routes, as_of, window_min).select("seq", "sent_immediately")
    marked = requests.join(sent, "seq", "left").withColumn(
        "notified", F.coalesce("notified", F.lit(False)) | F.coalesce("sent_immediately", F.lit(False)))
    return upsert_subscriptions(marked.drop("sent_immediately"), ttl)
