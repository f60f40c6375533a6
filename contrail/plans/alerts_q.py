"""Registered queries: subscriptions and landing alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators import alerts as A
from contrail.operators import latest as L
from contrail.plans import params as P
from contrail.plans.oracle_ctes import AS_OF_SQL, CAND, FS, SUBS, sql_instant, sql_strip, with_ctes
from contrail.plans.registry import register
from contrail.plans.routes_q import cached_routes
from contrail.plans.trails_q import history
from contrail.sources.standins import subscription_requests, unsubscribe_log, unsubscribe_requests
from contrail.sources.tables import table


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscription_requests(table(spark, sf_dir, "customer"), P.AS_OF)


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserted subscriptions after the delete requests."""
    subs = A.upsert_subscriptions(requests(spark, sf_dir), P.SUBSCRIPTION_TTL)
    return A.delete_subscriptions(subs, unsubscribe_requests(table(spark, sf_dir, "customer")))


_SUB_OUT = "email, icao24, callsign, notified, created_at, expires_at"


# ---------------------------------------------------------------- K8 F22
@register("subscription_upsert", with_ctes(SUBS) + f"\nSELECT {_SUB_OUT} FROM subs")
def subscription_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upsert_subscriptions(requests(spark, sf_dir), P.SUBSCRIPTION_TTL)


# ---------------------------------------------------------------- K9
@register("subscription_delete", with_ctes(SUBS) + f"\nSELECT {_SUB_OUT} FROM kept")
def subscription_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions(spark, sf_dir)


# ---------------------------------------------------------------- S7
@register("subscriptions_active", with_ctes(SUBS) + f"\nSELECT {_SUB_OUT} FROM active")
def subscriptions_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.active_subscriptions(subscriptions(spark, sf_dir), P.AS_OF)


# ---------------------------------------------------------------- J2 J3 P15 F10 K7 T7
def due_sql(now: str = AS_OF_SQL) -> str:
    """The alerts that are due at an instant, nothing having fired before."""
    return with_ctes(FS, CAND, SUBS, f"""
live AS (SELECT icao24, callsign FROM (
  SELECT icao24, callsign, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rk FROM fs) WHERE rk = 1),
s AS (
  SELECT a.email, a.icao24, a.notified, a.created_at, a.expires_at,
         COALESCE(NULLIF({sql_strip('a.callsign')}, ''), NULLIF({sql_strip('l.callsign')}, '')) AS callsign
  FROM kept a LEFT JOIN live l ON a.icao24 = l.icao24
  WHERE NOT a.notified AND a.expires_at > {now}
),
j AS (
  SELECT s.*, r.flight_number, r.origin_iata_code, r.origin_municipality, r.destination_iata_code, r.destination_municipality,
         r.actual_on, {sql_instant("COALESCE(NULLIF(r.estimated_on, ''), NULLIF(r.scheduled_on, ''))")} AS eta
  FROM s JOIN valid_routes r ON s.callsign = r.callsign
  WHERE NULLIF(r.actual_on, '') IS NULL
),
m AS (SELECT *, CAST(date_diff('microsecond', {now}, eta) AS DOUBLE) / CAST(60000000 AS DOUBLE) AS mins FROM j)""") + """
SELECT email, icao24, callsign, COALESCE(NULLIF(flight_number, ''), callsign) AS flight_number,
       COALESCE(origin_iata_code, '???') AS origin_iata, COALESCE(origin_municipality, '') AS origin_city, COALESCE(destination_iata_code, '???') AS dest_iata,
       COALESCE(destination_municipality, '') AS dest_city, CAST(trunc(mins) AS INTEGER) AS minutes, eta, strftime(eta, '%H:%M UTC') AS eta_text, created_at
FROM m WHERE mins > 0 AND mins <= 65"""


_DUE_SQL = due_sql()


@register("due_alerts", _DUE_SQL)
def due_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = L.latest_per_key(history(spark, sf_dir).select("icao24", "callsign", "time", "event_id"),
                            "icao24", ("time", "event_id"))
    return A.due_alerts(subscriptions(spark, sf_dir), live, cached_routes(spark, sf_dir), P.AS_OF, P.ALERT_WINDOW_MIN)


# ---------------------------------------------------------------- T8
_IMM_SQL = with_ctes(CAND, SUBS, f"""
rq AS (SELECT seq, email, icao24, {sql_strip('callsign')} AS callsign FROM req WHERE contains(email, '@')),
due AS (
  SELECT rq.seq FROM rq JOIN valid_routes r ON rq.callsign = r.callsign
  WHERE NULLIF(r.actual_on, '') IS NULL
    AND CAST(date_diff('microsecond', {AS_OF_SQL}, {sql_instant("COALESCE(NULLIF(r.estimated_on, ''), NULLIF(r.scheduled_on, ''))")}) AS DOUBLE)
        / CAST(60000000 AS DOUBLE) > 0
    AND CAST(date_diff('microsecond', {AS_OF_SQL}, {sql_instant("COALESCE(NULLIF(r.estimated_on, ''), NULLIF(r.scheduled_on, ''))")}) AS DOUBLE)
        / CAST(60000000 AS DOUBLE) <= 65
)""") + """
SELECT rq.seq, rq.email, lower(rq.icao24) AS icao24, rq.callsign, (due.seq IS NOT NULL) AS sent_immediately
FROM rq LEFT JOIN due ON rq.seq = due.seq"""


@register("subscribe_immediate", _IMM_SQL)
def subscribe_immediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.subscribe_immediate(requests(spark, sf_dir), cached_routes(spark, sf_dir), P.AS_OF, P.ALERT_WINDOW_MIN)


# ---------------------------------------------------------------- K8 K9 as one log
@register("subscription_replay", with_ctes(SUBS, """
log AS (
  SELECT email, lower(icao24) AS icao24, trim(callsign) AS callsign, notified, created_at, seq, FALSE AS gone
  FROM req WHERE contains(email, '@')
  UNION ALL
  SELECT 'U' || u || 'C' || c || '@EXAMPLE.COM', lpad(CAST(u AS VARCHAR), 6, '0'), NULL, FALSE, created + INTERVAL 10 MINUTE, c * 3, TRUE
  FROM cust WHERE c % 9 = 0
  UNION ALL
  SELECT 'U' || u || 'C' || c || '@EXAMPLE.COM', 'ffffff', NULL, FALSE, created + INTERVAL 10 MINUTE, c * 3, TRUE
  FROM cust WHERE c % 27 = 0),
newest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24, lower(email) ORDER BY created_at DESC, seq DESC) AS rk FROM log)""") + """
SELECT email, icao24, callsign, notified, created_at, created_at + INTERVAL 24 HOUR AS expires_at
FROM newest WHERE rk = 1 AND NOT gone""")
def subscription_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and deletes in the order they came: who unsubscribes and then
    subscribes again is subscribed."""
    gone = unsubscribe_log(table(spark, sf_dir, "customer"), P.AS_OF)
    return A.replay_subscriptions(requests(spark, sf_dir), gone, P.SUBSCRIPTION_TTL)


# ---------------------------------------------------------------- T8 into K8
@register("subscribe_state", "WITH imm AS (" + _IMM_SQL + """),
""" + with_ctes(SUBS, """
ranked AS (
  SELECT req.*, sent_immediately, ROW_NUMBER() OVER (PARTITION BY lower(req.icao24), lower(req.email)
                                                     ORDER BY created_at DESC, req.seq DESC) AS rk
  FROM req JOIN imm ON req.seq = imm.seq)""").strip().removeprefix("WITH") + f"""
SELECT email, lower(icao24) AS icao24, {sql_strip('callsign')} AS callsign, notified OR sent_immediately AS notified,
       created_at, created_at + INTERVAL 24 HOUR AS expires_at FROM ranked WHERE rk = 1""")
def subscribe_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscription table after the requests, with those mailed at once
    stored as notified."""
    return A.subscribe(requests(spark, sf_dir), cached_routes(spark, sf_dir), P.AS_OF, P.SUBSCRIPTION_TTL, P.ALERT_WINDOW_MIN)


# ---------------------------------------------------------------- T7 fire once
def _first_tick(spark: SparkSession, sf_dir: str):
    live = L.latest_per_key(history(spark, sf_dir).select("icao24", "callsign", "time", "event_id"),
                            "icao24", ("time", "event_id"))
    subs, routes = subscriptions(spark, sf_dir), cached_routes(spark, sf_dir)
    return subs, live, routes, A.due_alerts(subs, live, routes, P.AS_OF, P.ALERT_WINDOW_MIN)


@register("alerts_after_fire", "WITH due AS (" + _DUE_SQL + "),\n" + with_ctes(SUBS, """
hit AS (SELECT DISTINCT icao24 AS i, email AS e, created_at AS t FROM due)""").strip().removeprefix("WITH") + f"""
SELECT email, icao24, callsign, notified OR i IS NOT NULL AS notified, created_at,
       CASE WHEN i IS NOT NULL THEN greatest(expires_at, {AS_OF_SQL} + INTERVAL 1 HOUR) ELSE expires_at END AS expires_at
FROM kept LEFT JOIN hit ON i = icao24 AND e = email AND t = created_at""")
def alerts_after_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subscription table after a tick: whoever was mailed is notified and
    keeps at least an hour."""
    subs, _, _, fired = _first_tick(spark, sf_dir)
    return A.mark_notified(subs, fired, P.AS_OF)


_KEY = "icao24, email, created_at"


def _second_tick_sql(guard: str) -> str:
    return ("WITH due AS (" + _DUE_SQL + f"""),
first AS (SELECT {_KEY} FROM due WHERE CAST(substr(email, length(email) - 12, 1) AS VARCHAR) {guard})
SELECT due.* FROM due ANTI JOIN first USING ({_KEY})""")


@register("alerts_second_tick_notified", _second_tick_sql("IN ('0', '2', '4', '6', '8')"))
def alerts_second_tick_notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second tick guarded by the stored flag alone, after only the customers
    with an even number were mailed: the others are due, those are not."""
    subs, live, routes, fired = _first_tick(spark, sf_dir)
    some = fired.filter(F.substring("email", -13, 1).isin("0", "2", "4", "6", "8"))
    return A.due_alerts(A.mark_notified(subs, some, P.AS_OF), live, routes, P.AS_OF, P.ALERT_WINDOW_MIN)


@register("alerts_second_tick_fired", _second_tick_sql("IN ('1', '3', '5', '7', '9')"))
def alerts_second_tick_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second tick guarded by the log of fired alerts alone."""
    subs, live, routes, fired = _first_tick(spark, sf_dir)
    some = fired.filter(F.substring("email", -13, 1).isin("1", "3", "5", "7", "9"))
    return A.due_alerts(subs, live, routes, P.AS_OF, P.ALERT_WINDOW_MIN, fired=some)
