"""Registered queries: latest state, snapshot, phase, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.phase import flight_phase, phase_attributes
from contrail.functions.time import ntz
from contrail.operators import latest as L
from contrail.operators import trails as T
from contrail.plans import params as P
from contrail.plans.oracle_ctes import AS_OF_SQL, FS, with_ctes
from contrail.plans.registry import register
from contrail.plans.trails_q import history
from contrail.session import materialize
from contrail.sources.standins import wire_rows
from contrail.sources.tables import table
from contrail.sources.wire import states_from_wire

CLIENT_COLS = ("icao24", "callsign", "lat", "lon", "altitude", "velocity", "heading", "vertical_rate",
               "on_ground", "flight_phase", "category")
_CLIENT_SQL = ("icao24, callsign, latitude AS lat, longitude AS lon, baro_altitude AS altitude, velocity, "
               "true_track AS heading, vertical_rate, on_ground, COALESCE(flight_phase, 'CRUISE') AS flight_phase, category")


def wire_states(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Parsed wire messages (junk rows are all-null and carry no key), the
    ``columns`` asked for (default: all) landed once: a union plan over the JSON round trip and the long CASE chains of
    the stand-in takes the optimiser up to a minute otherwise (measured)."""
    states = states_from_wire(wire_rows(table(spark, sf_dir, "events")))
    return materialize(states.select(*columns) if columns else states)


# Wire messages in DuckDB: same rows, minus the malformed ones (they parse to
# all-null rows without a key, which every keyed operator skips).
WIRE = f"""
wire AS (
  SELECT icao24, callsign, latitude, longitude, baro_altitude, geo_altitude, on_ground, velocity, true_track,
         vertical_rate, squawk, category, flight_phase, time, event_id,
         CAST(icao24 AS BIGINT) % 4 AS partition,
         ((event_id * 7919) % 10007) * 1000000000 + event_id AS "offset"
  FROM fs WHERE event_id % 113 <> 0
)"""

_STATE_OUT = ["icao24", "callsign", "latitude", "longitude", "baro_altitude", "on_ground", "flight_phase", "time"]


# ---------------------------------------------------------------- A1
@register("latest_by_time", with_ctes(FS, """
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rn FROM fs)""") + """
SELECT icao24, time, event_id, callsign, latitude, longitude, baro_altitude, velocity, true_track, vertical_rate,
       on_ground, flight_phase, category FROM r WHERE rn = 1""")
def latest_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["icao24", "time", "event_id", "callsign", "latitude", "longitude", "baro_altitude", "velocity",
            "true_track", "vertical_rate", "on_ground", "flight_phase", "category"]
    return L.latest_per_key(history(spark, sf_dir).select(*cols), "icao24", ("time", "event_id"))


# ---------------------------------------------------------------- A2
@register("latest_by_arrival", with_ctes(FS, WIRE, """
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY "offset" DESC) AS rn FROM wire)""") + f"""
SELECT {", ".join(_STATE_OUT)}, "offset" FROM r WHERE rn = 1""")
def latest_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = wire_states(spark, sf_dir, *_STATE_OUT, "offset")
    return L.latest_per_key(s, "icao24", ("offset",))


# ---------------------------------------------------------------- U2 K3
_SPLIT = "2024-01-20 00:00:00"


@register("state_merge", with_ctes(FS, WIRE, f"""
old AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY "offset" DESC) AS rn
                 FROM wire WHERE time < TIMESTAMP '{_SPLIT}') WHERE rn = 1),
batch AS (SELECT * FROM wire WHERE time >= TIMESTAMP '{_SPLIT}'),
u AS (
  SELECT icao24, callsign, latitude, longitude, baro_altitude, on_ground, flight_phase, time, "offset", 0 AS gen FROM old
  UNION ALL
  SELECT icao24, callsign, latitude, longitude, baro_altitude, on_ground, flight_phase, time, "offset", 1 AS gen FROM batch),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY gen DESC, "offset" DESC) AS rn2 FROM u)""") + f"""
SELECT {", ".join(_STATE_OUT)}, "offset" FROM r WHERE rn2 = 1""")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = wire_states(spark, sf_dir, *_STATE_OUT, "offset")
    old = L.latest_per_key(s.filter(F.col("time") < ntz(_SPLIT)), "icao24", ("offset",))
    batch = s.filter(F.col("time") >= ntz(_SPLIT))
    return L.merge_state(old, batch, "icao24", ("offset",))


# ---------------------------------------------------------------- P6 F9
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live store as the API reads it: latest record per aircraft with
    its stamps as text in the forms producers write (Z suffix, +00:00,
    zone-less), some empty (fall back to `time`), some junk (kept)."""
    lt = L.latest_per_key(history(spark, sf_dir), "icao24", ("time", "event_id"))
    uid = F.col("icao24").cast("bigint")
    base = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ing = (F.when(uid % 7 == 0, F.lit(""))
           .when(uid % 11 == 0, F.lit("junk"))
           .when(uid % 3 == 0, F.concat(base, F.lit("Z")))
           .when(uid % 3 == 1, F.concat(base, F.lit("+00:00")))
           .otherwise(F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return lt.withColumn("ingested_at", ing).withColumn(
        "time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


LIVE = f"""
lt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rn FROM fs) WHERE rn = 1),
live AS (
  SELECT * REPLACE (
    CASE WHEN CAST(icao24 AS BIGINT) % 7 = 0 THEN ''
         WHEN CAST(icao24 AS BIGINT) % 11 = 0 THEN 'junk'
         WHEN CAST(icao24 AS BIGINT) % 3 = 0 THEN strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
         WHEN CAST(icao24 AS BIGINT) % 3 = 1 THEN strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'
         ELSE strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f') END AS ingested_at,
    strftime(time, '%Y-%m-%dT%H:%M:%S.%f') AS time)
  FROM lt
)"""


def _fresh_sql(max_age: str) -> str:
    return f"""
fresh AS (
  SELECT * FROM live
  WHERE TRY_CAST(regexp_replace(COALESCE(NULLIF(ingested_at, ''), NULLIF(time, '')), '(Z|\\+00:00)$', '') AS TIMESTAMP) IS NULL
     OR {AS_OF_SQL} - TRY_CAST(regexp_replace(COALESCE(NULLIF(ingested_at, ''), NULLIF(time, '')), '(Z|\\+00:00)$', '') AS TIMESTAMP)
        <= INTERVAL '{max_age}'
)"""


@register("stale_filter", with_ctes(FS, LIVE, _fresh_sql(P.LIVE_MAX_AGE)) + "\nSELECT icao24, ingested_at, time FROM fresh")
def stale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fresh_only(live_state(spark, sf_dir), P.AS_OF, P.LIVE_MAX_AGE).select("icao24", "ingested_at", "time")


# ---------------------------------------------------------------- U1 S3 S4 P7
def _snapshot(spark: SparkSession, sf_dir: str, max_age: str) -> DataFrame:
    return L.snapshot(live_state(spark, sf_dir), history(spark, sf_dir), P.AS_OF, max_age, P.FALLBACK_SPAN)


def _snapshot_sql(max_age: str) -> list[str]:
    return [FS, LIVE, _fresh_sql(max_age), f"""
cold AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, event_id DESC) AS rn
                 FROM fs WHERE time > {AS_OF_SQL} - INTERVAL '{P.FALLBACK_SPAN}') WHERE rn = 1
),
snap AS (
  SELECT {_CLIENT_SQL} FROM fresh
  UNION ALL
  SELECT {_CLIENT_SQL} FROM cold WHERE NOT EXISTS (SELECT 1 FROM fresh)
)"""]


@register("snapshot_hot_or_cold", with_ctes(*_snapshot_sql(P.LIVE_MAX_AGE)) + "\nSELECT * FROM snap")
def snapshot_hot_or_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, P.LIVE_MAX_AGE)


@register("snapshot_fallback", with_ctes(*_snapshot_sql(P.REF_LIVE_MAX_AGE)) + "\nSELECT * FROM snap")
def snapshot_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same question with the reference's 2-minute staleness: every live
    record is stale, so the history fallback answers."""
    return _snapshot(spark, sf_dir, P.REF_LIVE_MAX_AGE)


# ---------------------------------------------------------------- A6
@register("snapshot_count", with_ctes(*_snapshot_sql(P.LIVE_MAX_AGE)) + "\nSELECT CAST(count(*) AS BIGINT) AS count FROM snap")
def snapshot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.snapshot_count(_snapshot(spark, sf_dir, P.LIVE_MAX_AGE))


# ---------------------------------------------------------------- K6
@register("positions_message", with_ctes(*_snapshot_sql(P.LIVE_MAX_AGE)) + f"""
SELECT 'positions' AS type, {AS_OF_SQL} AS timestamp, (SELECT CAST(count(*) AS BIGINT) FROM snap) AS count, * FROM snap""")
def positions_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    # landed once (a row per aircraft): its rows and their number are two readings
    return L.positions_rows(materialize(_snapshot(spark, sf_dir, P.LIVE_MAX_AGE)), P.AS_OF)


# ---------------------------------------------------------------- P16
@register("message_type_filter", with_ctes(FS) + """
SELECT event_id, icao24, latitude AS lat, longitude AS lon FROM fs WHERE event_id % 9 <> 0""")
def message_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    msg_type = F.when(F.col("event_id") % 9 == 0, F.lit("heartbeat")).otherwise(F.lit("positions"))
    text = F.to_json(F.struct(msg_type.alias("type"), "event_id", "icao24",
                              F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    schema = "type string, event_id bigint, icao24 string, lat double, lon double"
    parsed = h.select(F.from_json(text, schema).alias("m")).select("m.*")
    return parsed.filter(F.col("type") == "positions").drop("type")


# ---------------------------------------------------------------- F8 X1 A7 P11 F21
@register("phase_rows", with_ctes(FS) + "\nSELECT event_id, icao24, flight_phase FROM fs")
def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("event_id", "icao24", "flight_phase")


@register("phase_rows_udf_rule", with_ctes(FS) + """
SELECT event_id,
  CASE WHEN on_ground = TRUE THEN 'GROUND'
       WHEN COALESCE(vertical_rate, CAST(0 AS DOUBLE)) > CAST(1 AS DOUBLE) THEN 'CLIMBING'
       WHEN COALESCE(vertical_rate, CAST(0 AS DOUBLE)) < CAST(-1 AS DOUBLE) THEN 'DESCENDING'
       ELSE 'CRUISE' END AS flight_phase
FROM fs""")
def phase_rows_udf_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    rule = flight_phase(climb=1.0, descend=-1.0, ceiling=None, null_rate_as_zero=True)
    return h.select("event_id", rule.alias("flight_phase"))


@register("phase_counts", with_ctes(FS) + """
SELECT CAST(count(*) FILTER (WHERE flight_phase = 'GROUND') AS BIGINT) AS GROUND,
       CAST(count(*) FILTER (WHERE flight_phase = 'CLIMBING') AS BIGINT) AS CLIMBING,
       CAST(count(*) FILTER (WHERE flight_phase = 'CRUISE') AS BIGINT) AS CRUISE,
       CAST(count(*) FILTER (WHERE flight_phase = 'DESCENDING') AS BIGINT) AS DESCENDING
FROM fs""")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.phase_counts(history(spark, sf_dir))


@register("phase_filter", with_ctes(FS) + "\nSELECT event_id, icao24, time FROM fs WHERE flight_phase = 'CLIMBING'")
def phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).filter(F.col("flight_phase") == "CLIMBING").select("event_id", "icao24", "time")


@register("phase_attributes", with_ctes(FS, """
dim AS (SELECT * FROM (VALUES
  ('GROUND', 'Ground', 'GND', '#a0a0aa', '#a0a0aa'),
  ('CLIMBING', 'Climbing', 'CLB', '#00dc78', '#00dc78'),
  ('CRUISE', 'Cruise', 'CRZ', '#00e5ff', '#32a0ff'),
  ('DESCENDING', 'Descending', 'DSC', '#ffaa00', '#ffaa00')) AS t(flight_phase, label, short_label, badge_color, list_color))""") + """
SELECT d.flight_phase, d.label, d.short_label, d.badge_color, d.list_color, CAST(count(f.event_id) AS BIGINT) AS n
FROM dim d LEFT JOIN fs f ON f.flight_phase = d.flight_phase
GROUP BY d.flight_phase, d.label, d.short_label, d.badge_color, d.list_color""")
def phase_attributes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = history(spark, sf_dir).groupBy("flight_phase").agg(F.count(F.lit(1)).alias("n"))
    dim = phase_attributes(spark)  # 4 rows: a proven bound, broadcast is safe
    return (F.broadcast(dim).join(counts, "flight_phase", "left")
            .select("flight_phase", "label", "short_label", "badge_color", "list_color",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


# ---------------------------------------------------------------- T6
@register("retention_filter", with_ctes(FS) + f"""
SELECT event_id, icao24, time FROM fs WHERE time > {AS_OF_SQL} - INTERVAL '{P.RETENTION}'""")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.within_window(history(spark, sf_dir), P.AS_OF, P.RETENTION).select("event_id", "icao24", "time")


# ---------------------------------------------------------------- W5
ROLLING_TRAIL_SQL = with_ctes(FS, WIRE, """
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY "offset" DESC) AS rn FROM wire
      WHERE latitude IS NOT NULL AND longitude IS NOT NULL)""") + f"""
SELECT icao24, CAST(rn AS BIGINT) AS rn, longitude AS lon, latitude AS lat FROM r WHERE rn <= {P.ROLLING_TRAIL_POINTS}"""


@register("rolling_trail", ROLLING_TRAIL_SQL)
def rolling_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = wire_states(spark, sf_dir, "icao24", "latitude", "longitude", "offset").filter(F.col("icao24").isNotNull())
    return T.rolling_trail_end_state(s, P.ROLLING_TRAIL_POINTS, ("offset",))


# ---------------------------------------------------------------- W5 (per row)
@register("rolling_trail_rows", with_ctes(FS, WIRE, f"""
w AS (
  SELECT icao24, "offset",
    CAST(count(*) OVER t AS BIGINT) AS trail_len,
    first_value(longitude) OVER t AS oldest_lon, first_value(latitude) OVER t AS oldest_lat
  FROM wire WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  WINDOW t AS (PARTITION BY icao24 ORDER BY "offset" ROWS BETWEEN {P.ROLLING_TRAIL_POINTS - 1} PRECEDING AND CURRENT ROW)
)""") + "\nSELECT * FROM w")
def rolling_trail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = wire_states(spark, sf_dir, "icao24", "latitude", "longitude", "offset").filter(F.col("icao24").isNotNull())
    # buckets of the arrival order (offsets are spaced by 1e9 per slot)
    rows = T.rolling_trail_rows(s, P.ROLLING_TRAIL_POINTS, ("offset",),
                                bucket=F.floor(F.col("offset") / F.lit(10 ** 12)))
    return rows.select("icao24", "offset", F.size("trail").cast("bigint").alias("trail_len"),
                       F.col("trail")[0][0].alias("oldest_lon"), F.col("trail")[0][1].alias("oldest_lat"))
