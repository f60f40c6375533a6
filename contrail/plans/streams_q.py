"""Registered streaming queries.

Each one lands the keyed wire messages derived from `events` as JSON files,
runs the streaming job over them with ``availableNow`` (several
micro-batches), and returns the table the job wrote. The end state of a
stream does not depend on how the input is cut into micro-batches, so each
one has a SQL oracle: the batch answer over the same messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from contrail.functions.text import subscription_key
from contrail.functions.time import ntz
from contrail.operators.latest import latest_per_key
from contrail.plans import params as P
from contrail.plans.alerts_q import due_sql, requests, subscriptions
from contrail.plans.geo_q import _DEADBAND_SQL
from contrail.plans.oracle_ctes import AS_OF_SQL, CAND, FS, SUBS, with_ctes
from contrail.plans.registry import register
from contrail.plans.routes_q import cached_routes, candidates
from contrail.plans.snapshot_q import _CLIENT_SQL, ROLLING_TRAIL_SQL, WIRE
from contrail.plans.trails_q import history
from contrail.schema import HISTORY_COLUMNS_WITH_CATEGORY, client_columns
from contrail.session import shared_dir
from contrail.sinks import history as H
from contrail.sinks.alerts import read_alerts
from contrail.sources.standins import unsubscribe_log, untimed, wire_rows
from contrail.sources.tables import table
from contrail.sources.wire import states_from_wire
from contrail.streaming import pipeline as S
from contrail.streaming import state as ST
from contrail.streaming import ticks as TK

BATCHES = 4                 # micro-batches that the landed messages make up
FILES_PER_TRIGGER = 8       # at least; more where a file would be large
ROWS_PER_FILE = 250_000

# History as the fan-out writes it: every keyed, stamped message once (the
# malformed ones go to quarantine), with its `date` partition column.
HISTORY_SQL = with_ctes(FS) + f"""
SELECT {", ".join(HISTORY_COLUMNS_WITH_CATEGORY)}, CAST(time AS DATE) AS date FROM fs WHERE event_id % 113 <> 0"""

_LATEST_COLS = ("icao24", "callsign", "latitude", "longitude", "on_ground", "flight_phase", "time", "offset")
LATEST_SQL = with_ctes(FS, WIRE, """
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY icao24 ORDER BY time DESC, "offset" DESC) AS rn FROM wire)""") + f"""
SELECT {", ".join('"offset"' if c == "offset" else c for c in _LATEST_COLS)} FROM r WHERE rn = 1"""


def land_wire_files(spark: SparkSession, sf_dir: str, change=lambda w: w) -> str:
    """Write the wire messages as JSON files, hash-partitioned by key (one
    key -> one file, like one topic partition)."""
    root = shared_dir(spark, "wire")
    events = table(spark, sf_dir, "events")
    w = change(wire_rows(events)).select("key", "value", "partition", "offset", "timestamp")
    w.repartition(BATCHES * per_trigger(events), "key").write.json(root)
    return root


def per_trigger(rows: DataFrame) -> int:
    """Files of one micro-batch: in proportion to the rows."""
    return max(FILES_PER_TRIGGER, -(-rows.count() // (BATCHES * ROWS_PER_FILE)))


def land_in_time(rows: DataFrame, by: str, form: str = "parquet", batches: int = BATCHES) -> str:
    """Write rows as files that a stream reads one slice of time after the
    other (a slice each micro-batch), as a feed would bring them."""
    root = shared_dir(rows.sparkSession, "feed")
    at = F.unix_micros(F.col(by).cast("timestamp"))
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    slice_ = F.least(F.floor((at - F.lit(lo or 0)) / F.lit(max(1.0, ((hi or 0) - (lo or 0)) / batches))), F.lit(batches - 1))
    for i in range(batches):
        rows.filter(slice_ == i).repartition(FILES_PER_TRIGGER).write.mode("append").format(form).save(root)
    return root


def _feed(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(root)


def _end_of(stream: DataFrame, purpose: str, mode: str = "update") -> DataFrame:
    """Everything a stream put out until its input ended, with the batch it came in."""
    base = shared_dir(stream.sparkSession, purpose)
    _run(stream.writeStream.outputMode(mode).foreachBatch(_updates_sink(f"{base}/updates"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    schema = StructType([*stream.schema, StructField("batch_id", IntegerType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{base}/updates")


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _ingest(spark: SparkSession, sf_dir: str, extra=None, src: str | None = None, files: int | None = None, **how):
    src = src or land_wire_files(spark, sf_dir)
    base = shared_dir(spark, "ingest")
    hist, state, quar, ck = (f"{base}/{p}" for p in ("history", "state", "quarantine", "checkpoint"))
    stream = S.wire_file_stream(spark, src, files or per_trigger(table(spark, sf_dir, "events")))
    _run(S.start_ingest(stream, ck, S.fan_out(hist, state, quar, extra, **how), {"availableNow": True}))
    return hist, state, quar


@register("stream_enrich", HISTORY_SQL)
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History written by the streaming fan-out."""
    hist, _, _ = _ingest(spark, sf_dir)
    return H.read_history(spark, hist)


@register("history_append_replay", HISTORY_SQL)
def history_append_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 K4 A10: the sink fails once right after writing history for batch 1;
    the restarted query replays batch 1 and history ends without duplicates."""
    src = land_wire_files(spark, sf_dir)
    base = shared_dir(spark, "replay")
    hist, state, quar, ck = (f"{base}/{p}" for p in ("history", "state", "quarantine", "checkpoint"))
    inner = S.fan_out(hist, state, quar)
    crashed = {"done": False}

    def flaky(batch, batch_id):
        inner(batch, batch_id)
        if batch_id == 1 and not crashed["done"]:
            crashed["done"] = True
            raise RuntimeError("simulated executor loss after the history write")

    q = S.start_ingest(S.wire_file_stream(spark, src, FILES_PER_TRIGGER), ck, flaky, {"availableNow": True})
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001 - the simulated failure
        pass
    _run(S.start_ingest(S.wire_file_stream(spark, src, FILES_PER_TRIGGER), ck, inner, {"availableNow": True}))
    return H.read_history(spark, hist)


@register("ingest_accounting", """
SELECT 'in' AS outcome, count(*) AS n FROM events
UNION ALL SELECT 'history', count(*) FROM events WHERE event_id % 113 <> 0 AND event_id % 101 <> 0 AND event_id % 103 <> 0
UNION ALL SELECT 'quarantine: no key', count(*) FROM events WHERE event_id % 113 = 0
UNION ALL SELECT 'quarantine: no time', count(*) FROM events
WHERE event_id % 113 <> 0 AND (event_id % 101 = 0 OR event_id % 103 = 0)""")
def ingest_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is in history or, with a reason, in quarantine,
    also those without a readable time."""
    src = land_wire_files(spark, sf_dir, untimed)
    hist, _, quar = _ingest(spark, sf_dir, src=src)
    n = F.count(F.lit(1)).alias("n")
    rows = [spark.read.schema(S.WIRE_FILE_SCHEMA).json(src).select(F.lit("in").alias("outcome")),
            H.read_history(spark, hist).select(F.lit("history").alias("outcome")),
            spark.read.parquet(quar).select(F.concat(F.lit("quarantine: "), "reason").alias("outcome"))]
    return rows[0].union(rows[1]).union(rows[2]).groupBy("outcome").agg(n)


def _updates_sink(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")
    return write


def _latest_sql(order: str) -> str:
    return LATEST_SQL.replace('ORDER BY time DESC, "offset" DESC', f"ORDER BY {order}")


@register("stream_latest", LATEST_SQL)
def stream_latest(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None,
                  order: tuple[str, ...] = ("time", "offset")) -> DataFrame:
    """Keyed latest state over the stream, by event time; the end
    state is the last update per key."""
    src = land_wire_files(spark, sf_dir)
    enriched = states_from_wire(S.wire_file_stream(spark, src, files_per_trigger or per_trigger(table(spark, sf_dir, "events")))).select(*_LATEST_COLS)
    ups = _end_of(ST.latest_state(enriched, "icao24", order), "latest")
    return latest_per_key(ups, "icao24", ("batch_id",)).drop("batch_id")


@register("stream_latest_arrival", _latest_sql('"offset" DESC'))
def stream_latest_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the order of arrival."""
    return stream_latest(spark, sf_dir, order=("offset",))


@register("stream_state_table", LATEST_SQL)
def stream_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest-state table that the fan-out keeps, as last committed."""
    _, state, _ = _ingest(spark, sf_dir)
    return S.read_state(spark, state).select(*_LATEST_COLS)


@register("stream_state_table_arrival", _latest_sql('"offset" DESC'))
def stream_state_table_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table in the order of arrival: a late row overwrites."""
    _, state, _ = _ingest(spark, sf_dir, state_order=("offset",))
    return S.read_state(spark, state).select(*_LATEST_COLS)


@register("stream_trail", ROLLING_TRAIL_SQL)
def stream_trail(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """T4: rolling 20-point trail state; the end state per key is its last
    emitted trail."""
    src = land_wire_files(spark, sf_dir)
    enriched = states_from_wire(S.wire_file_stream(spark, src, files_per_trigger or per_trigger(table(spark, sf_dir, "events"))))
    ups = _end_of(ST.rolling_trail(enriched, 20, "offset"), "trail")
    last = ups.groupBy("icao24").agg(F.max("batch_id").alias("batch_id"))
    return ups.join(last, ["icao24", "batch_id"]).select("icao24", "rn", "lon", "lat")


# ---------------------------------------------------------------- T9 F6
TICK, LATE = "3 hours", "12 hours"


@register("snapshot_ticks", with_ctes(FS, WIRE, """
lim AS (SELECT max(time) - INTERVAL 12 HOUR AS until, time_bucket(INTERVAL 3 HOUR, min(time)) AS since FROM wire),
tick AS (SELECT unnest(generate_series(since, until, INTERVAL 3 HOUR)) AS tick_time FROM lim),
seen AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tick_time, icao24 ORDER BY time DESC, "offset" DESC) AS rn
         FROM tick JOIN wire ON time >= tick_time - INTERVAL 6 HOUR AND time < tick_time)""") + f"""
SELECT tick_time, {_CLIENT_SQL} FROM seen WHERE rn = 1""")
def snapshot_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three hours of the stream's clock, the aircraft seen in the
    last six; messages come up to six hours out of order."""
    w = wire_rows(table(spark, sf_dir, "events"))
    late = (F.col("event_id") % 7) * F.expr("INTERVAL 1 HOUR")
    src = land_in_time(w.withColumn("came", F.col("timestamp") + late).drop("event_id", "topic"), "came", "json")
    states = states_from_wire(S.wire_file_stream(spark, src, FILES_PER_TRIGGER))
    cols = ["icao24", "callsign", "latitude", "longitude", "baro_altitude", "velocity", "true_track", "vertical_rate", "on_ground",
            "flight_phase", "category"]
    out = TK.snapshots(states, cols, TICK, P.LIVE_MAX_AGE, LATE)
    return _end_of(out, "ticks", "append").select("tick_time", *client_columns(out))


# ---------------------------------------------------------------- T5 K8 K9 K10 as keyed state
@register("stream_subscriptions", with_ctes(SUBS, """
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
SELECT email, icao24, callsign, notified, created_at FROM newest
WHERE rk = 1 AND NOT gone AND created_at + INTERVAL 24 HOUR > (SELECT max(created_at) - INTERVAL 2 HOUR FROM log)""")
def stream_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 K9 T5: subscriptions as a stream of requests and deletes; who is
    deleted or a day old is gone at the end."""
    log = requests(spark, sf_dir).filter(F.col("email").contains("@")).select(
        "email", F.lower("icao24").alias("icao24"), F.trim("callsign").alias("callsign"), "notified", "created_at", "seq", F.lit(False).alias("gone"))
    log = log.unionByName(unsubscribe_log(table(spark, sf_dir, "customer"), P.AS_OF).select(
        "email", F.lower("icao24").alias("icao24"), F.lit(None).cast("string").alias("callsign"), F.lit(False).alias("notified"),
        "created_at", "seq", F.lit(True).alias("gone")))
    stream = _feed(spark, land_in_time(log, "created_at"), log.schema)
    key = F.concat_ws(" ", *subscription_key(F.col("icao24"), F.col("email")))
    changes = ST.keyed_changes(stream, key, "created_at", F.col("seq"), P.SUBSCRIPTION_TTL, F.col("gone"), late="2 hours")
    return ST.entries(_end_of(changes, "subscriptions"), "email string, icao24 string, callsign string, notified boolean, created_at timestamp_ntz")


@register("stream_routes", with_ctes(CAND, f"""
puts AS (SELECT callsign, pos, estimated_on, {AS_OF_SQL} - to_hours(CAST((pos * 7) % 24 AS INTEGER)) - INTERVAL 30 MINUTE AS cached_at FROM cand),
newest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY callsign ORDER BY cached_at DESC, pos DESC) AS rk FROM puts WHERE callsign IS NOT NULL)""") + """
SELECT callsign, pos, estimated_on, cached_at FROM newest
WHERE rk = 1 AND cached_at + INTERVAL 12 HOUR > (SELECT max(cached_at) - INTERVAL 1 HOUR FROM newest)""")
def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route cache as a stream of puts; a route that nobody put
    again for twelve hours is gone."""
    cached = ntz(P.AS_OF) - F.make_dt_interval(hours=((F.col("pos") * 7) % 24).cast("int")) - F.expr("INTERVAL 30 MINUTES")
    puts = candidates(spark, sf_dir).select("callsign", "pos", "estimated_on", cached.alias("cached_at"))
    stream = _feed(spark, land_in_time(puts, "cached_at"), puts.schema)
    changes = ST.keyed_changes(stream, F.col("callsign"), "cached_at", F.col("pos"), P.ROUTE_TTL, late="1 hour")
    return ST.entries(_end_of(changes, "routes"), "callsign string, pos bigint, estimated_on string, cached_at timestamp_ntz")


# ---------------------------------------------------------------- T6 K2
@register("history_retention", f"""
WITH hist AS ({HISTORY_SQL})
SELECT * FROM hist WHERE date >= CAST({AS_OF_SQL} - INTERVAL 7 DAY AS DATE)""")
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History after the dates older than a week were dropped."""
    hist, _, _ = _ingest(spark, sf_dir)
    H.retain(spark, hist, P.AS_OF, P.RETENTION)
    return H.read_history(spark, hist)


@register("history_compacted", HISTORY_SQL)
def history_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: history after the segments of every date but the newest batch's were rewritten as one."""
    hist, _, _ = _ingest(spark, sf_dir)
    H.compact(spark, hist, most_segments=1)
    return H.read_history(spark, hist)


# ---------------------------------------------------------------- T7
_LATER = f"({AS_OF_SQL} + INTERVAL 20 MINUTE)"


@register("stream_alert_ticks", f"""
WITH a AS ({due_sql()}), b AS ({due_sql(_LATER)})
SELECT 0 AS tick_id, a.* FROM a UNION ALL SELECT 1, b.* FROM b ANTI JOIN a USING (icao24, email, created_at)""")
def stream_alert_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ticks twenty minutes apart; the second batch dies after its
    alerts were written and runs again. Nobody is mailed twice."""
    root, feed = shared_dir(spark, "alerts"), shared_dir(spark, "tick-feed")
    for minutes in (0, 20):
        spark.range(1).select((ntz(P.AS_OF) + F.expr(f"INTERVAL {minutes} MINUTES")).alias("as_of")).coalesce(1).write.mode("append").parquet(feed)
    live = latest_per_key(history(spark, sf_dir).select("icao24", "callsign", "time", "event_id"), "icao24", ("time", "event_id"))
    tick = TK.alert_tick(lambda: subscriptions(spark, sf_dir), lambda: live, lambda: cached_routes(spark, sf_dir), root, P.ALERT_WINDOW_MIN)
    crashed = []

    def dies_once(batch: DataFrame, batch_id: int) -> None:
        tick(batch, batch_id)
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            raise RuntimeError("simulated loss after the alerts were written")

    def run():
        stream = spark.readStream.schema("as_of timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(feed)
        return stream.writeStream.foreachBatch(dies_once).option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start()

    try:
        run().awaitTermination()
    except Exception:  # noqa: BLE001 - the simulated failure
        if not crashed:
            raise
    _run(run())
    return read_alerts(spark, root).drop("eta_date")


# ---------------------------------------------------------------- P17
@register("stream_deadband", _DEADBAND_SQL)
def stream_deadband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 on a stream: the points that moved, one reference point per aircraft in state."""
    rows = history(spark, sf_dir).select("icao24", "time", "event_id", "latitude", "longitude")
    stream = _feed(spark, land_in_time(rows, "time"), rows.schema)
    return _end_of(ST.moved_points(stream, 0.001), "deadband", "append").drop("batch_id")
