"""Batch = stream, and replay after a failure leaves history whole."""

import datetime as dt
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from contrail.operators import geo as G
from contrail.operators.latest import latest_per_key
from contrail.plans import snapshot_q, streams_q
from contrail.plans.registry import queries
from contrail.plans.trails_q import history
from contrail.session import shared_dir
from contrail.sinks import history as H
from contrail.sinks.alerts import read_alerts
from contrail.sinks.pointer import read_pointer
from contrail.streaming import pipeline as S
from contrail.streaming import state as ST
from contrail.streaming import ticks as TK
from tests._compare import spark_rows
from tests.conftest import SF_SMALL


def test_stream_latest_equals_batch(spark):
    streamed = streams_q.stream_latest(spark, SF_SMALL)
    batch = queries()["latest_by_arrival"](spark, SF_SMALL)
    ws = snapshot_q.wire_states(spark, SF_SMALL).filter(F.col("icao24").isNotNull())
    want = latest_per_key(ws.select(*streamed.columns), "icao24", ("time", "offset"))
    assert spark_rows(streamed) == spark_rows(want)
    assert streamed.count() == batch.count()


@pytest.mark.parametrize("per_trigger", [1, 3, 100])
def test_stream_state_independent_of_batching(spark, per_trigger):
    latest = streams_q.stream_latest(spark, SF_SMALL, files_per_trigger=per_trigger)
    ws = snapshot_q.wire_states(spark, SF_SMALL).filter(F.col("icao24").isNotNull())
    want = latest_per_key(ws.select(*latest.columns), "icao24", ("time", "offset"))
    assert spark_rows(latest) == spark_rows(want)
    trail = streams_q.stream_trail(spark, SF_SMALL, files_per_trigger=per_trigger)
    assert spark_rows(trail) == spark_rows(queries()["rolling_trail"](spark, SF_SMALL).select(*trail.columns))


def test_stream_trail_equals_batch_end_state(spark):
    streamed = streams_q.stream_trail(spark, SF_SMALL)
    batch = queries()["rolling_trail"](spark, SF_SMALL)
    assert spark_rows(streamed) == spark_rows(batch.select(*streamed.columns))


def test_stream_history_equals_batch_parse(spark):
    hist = streams_q.stream_enrich(spark, SF_SMALL)
    parsed = queries()["parse_wire_json"](spark, SF_SMALL).filter(F.col("icao24").isNotNull())
    assert spark_rows(hist.select(*parsed.columns)) == spark_rows(parsed)


def test_replay_has_no_duplicates(spark):
    hist = streams_q.history_append_replay(spark, SF_SMALL)
    clean = streams_q.stream_enrich(spark, SF_SMALL)
    assert hist.count() == clean.count()
    assert hist.groupBy("icao24", "time").count().filter("count > 1").count() == 0


T0 = dt.datetime(2024, 1, 1)
STATE = "icao24 string, time timestamp_ntz, timestamp timestamp_ntz, offset bigint, callsign string"


def fed(spark, batches, schema):
    """A stream that brings one file per micro-batch."""
    root = shared_dir(spark, "fed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def test_a_record_from_the_future_does_not_age_the_fleet(spark):
    """One record is stamped ten years ahead; the clock goes by its arrival."""
    far = dt.datetime(2034, 1, 1)
    batches = [[("a", minute(1), minute(1), 1, "A1"), ("b", minute(2), minute(2), 2, "B1"), (None, minute(2), minute(2), 3, "X"), ("", minute(2), minute(2), 3, "X")],
               [("c", far, minute(3), 4, "C1"), ("a", minute(4), minute(4), 5, "A2"), ("d", None, minute(4), 6, "D1")],
               [("b", minute(13), minute(13), 7, "B2"), ("a", minute(11), minute(13), 8, "A3")],
               [("z", minute(60), minute(60), 9, "Z1")]]
    out = TK.snapshots(fed(spark, batches, STATE), ["icao24", "callsign"], "5 minutes", "10 minutes", late="5 minutes", tolerance="1 minute")
    got = streams_q._end_of(out, "ticks", "append")
    seen = {(r.tick_time, r.icao24, r.callsign) for r in got.collect()}
    at = {m: {(i, c) for t, i, c in seen if t == minute(m)} for m in range(0, 60, 5)}
    assert at[5] == {("a", "A2"), ("b", "B1"), ("c", "C1")} == at[10]
    assert at[15] == {("a", "A3"), ("b", "B2")} == at[20]
    assert at[25] == set() and len(seen) == got.count() == 10


class Calls:
    """A state handle that counts the calls."""

    def __init__(self):
        self.made, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            self.made += name not in ("getValueState", "getMapState")
            if name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            elif name in ("update", "clear"):
                self.value = args[0] if args else None
            return self.value if name == "get" else iter(()) if name == "iterator" else self
        return call


def test_a_trail_batch_costs_two_calls_however_many_points():
    calls, trail = Calls(), ST.Trail(20)
    trail.init(calls)
    for batch in range(3):
        rows = [{"icao24": f"a{a}", "ord": 100 * batch + o, "lon": 1.0 * o, "lat": 2.0} for a in range(30) for o in range(25)]
        out = list(trail.handleInputRows((7,), iter(rows), None))
        assert calls.made == 2 * (batch + 1) and len(out) == 30 * 20
        assert [(r.ord, r.lon) for r in out if r.icao24 == "a3"] == [(100 * batch + o, float(o)) for o in range(24, 4, -1)]


def test_changes_cost_a_few_calls_and_one_timer_a_bucket():
    calls, changes = Calls(), ST.Changes()
    changes.init(calls)
    row = lambda k, at: {"key": f"k{k}", "at": at, "seq": 1, "gone": False, "expires": at + 10_000, "entry": f"e{at}"}
    assert len(list(changes.handleInputRows((7,), iter([row(k, 1000 * k) for k in range(50, 150)]), None))) == 100
    assert calls.made == 3 and calls.timers == {60}
    assert list(changes.handleInputRows((7,), iter([row(50, 1000)]), None)) == []     # older than what is there
    assert len(list(changes.handleInputRows((7,), iter([row(1, 1000), row(50, 90_000)]), None))) == 2
    assert calls.made == 8 and calls.timers == {11}
    timer, clock = SimpleNamespace(getExpiryTimeInMs=lambda: 11), SimpleNamespace(getCurrentWatermarkInMs=lambda: 71)
    gone = {r.key for r in changes.handleExpiredTimer((7,), clock, timer)}
    assert gone == {"k1", *(f"k{k}" for k in range(51, 62))}     # 71 itself is over; Spark drops the timer that went off
    assert calls.timers == {11, 72}


@pytest.mark.parametrize("tick,age", [("7 minutes", "10 minutes"), ("10 minutes", "5 minutes")])
def test_ticks_that_do_not_divide_the_age(spark, tick, age):
    with pytest.raises(ValueError):
        TK.snapshots(fed(spark, [[("a", T0, T0, 1, "A")]], STATE), ["icao24"], tick, age)


def test_trail_keeps_the_newest_points_whatever_the_batches(spark):
    """An aircraft with most of the rows, over batches that overlap in their offsets."""
    schema = "icao24 string, offset bigint, longitude double, latitude double"
    batches = [[("a", o * 3 + b, float(o), float(b)) for o in range(400)] + [("b", b, 1.0, 2.0), ("c", 10 * b, None, 1.0)] for b in range(3)]
    ups = streams_q._end_of(ST.rolling_trail(fed(spark, batches, schema), 20), "trail")
    last = ups.groupBy("icao24").agg(F.max("batch_id").alias("batch_id"))
    got = {(r.icao24, r.rn): (r.ord, r.lon, r.lat) for r in ups.join(last, ["icao24", "batch_id"]).collect()}
    newest = sorted((r for b in batches for r in b if r[0] == "a"), key=lambda r: -r[1])[:20]
    assert [got["a", i] for i in range(1, 21)] == [(o, lo, la) for _, o, lo, la in newest]
    assert [got["b", i][0] for i in (1, 2, 3)] == [2, 1, 0] and len(got) == 23


CHANGE = "id string, at timestamp_ntz, seq bigint, gone boolean, v string"


def changes_of(spark, batches, ttl="30 minutes", late="20 minutes", **how):
    stream = fed(spark, batches, CHANGE)
    out = streams_q._end_of(ST.keyed_changes(stream, F.lower("id"), "at", F.col("seq"), ttl, F.col("gone"), late, **how), "changes")
    return out, {r.id: r.v for r in ST.entries(out, CHANGE).collect()}


def test_deletes_that_come_late_and_entries_that_expire(spark):
    batches = [
        [("A", minute(0), 1, False, "a0"), ("b", minute(1), 2, False, "b0"), ("c", minute(2), 3, False, "c0"), (None, minute(2), 3, False, "x"), ("n", None, 3, False, "x")],
        [("a", minute(10), 5, True, None), ("c", minute(9), 4, False, "c1")],
        [("a", minute(5), 9, False, "late, older than the delete"), ("B", minute(8), 4, False, "b1"), ("d", minute(12), 6, False, "d0"), ("d", minute(12), 7, False, "d1")],
        [("b", minute(3), 8, True, "late, older than b1")],
        [("e", minute(59), 9, False, "e0")],  # the clock stands at 39: c1 expires, b1 a minute before
        [("f", minute(60), 9, False, "f0")],
    ]
    out, live = changes_of(spark, batches)
    assert live == {"d": "d1", "e": "e0", "f": "f0"}
    kinds = sorted((r.key, r.change) for r in out.collect())
    assert kinds == sorted([("a", "live"), ("a", "deleted"), ("a", "expired"), ("b", "live"), ("b", "live"), ("b", "expired"), ("c", "live"),
                            ("c", "live"), ("c", "expired"), ("d", "live"), ("e", "live"), ("f", "live")])


def test_buckets_change_nothing(spark):
    """Keys that share a bucket, or do not: the same changes in the same micro-batches, also at the very end of a life."""
    batches = [[(f"k{k}", minute(k % 9), k, False, f"v{k}") for k in range(40)],
               [(f"K{k}", minute(10), 50 + k, k % 2 == 0, f"w{k}") for k in range(0, 40, 3)],
               [("far", minute(50 + 5), 99, False, "clock at 35")], [("far", minute(58), 100, False, "clock at 38")], [("far", minute(61), 101, False, "clock at 41")]]
    one, many = (changes_of(spark, batches, buckets=b) for b in (1, 1024))
    assert spark_rows(one[0]) == spark_rows(many[0]) and one[1] == many[1] == {"far": "clock at 41"}
    rows = [[(f"a{i % 7}", i * 3 + b, float(i), float(b)) for i in range(300)] for b in range(3)]
    ups = [streams_q._end_of(ST.rolling_trail(fed(spark, rows, "icao24 string, offset bigint, longitude double, latitude double"), 20, buckets=b), "trail") for b in (1, 1024)]
    assert spark_rows(ups[0]) == spark_rows(ups[1]) and ups[0].count() == 3 * 7 * 20


def test_slices_keep_the_newest_rows_of_every_key(spark):
    rows = [(f"k{i % 11 if i % 5 else 3}", (i * 7919) % 30_011) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k string, o bigint").coalesce(1)
    want = {k: sorted((o for x, o in rows if x == k), reverse=True)[:20] for k in {k for k, _ in rows}}
    for size, most in ((1, None), (2000, 4000), (131_072, 220)):
        got = ST.last_of_slices(df, "k", "o", 20, size).collect()
        assert most is None or len(got) <= most
        assert {k: sorted((o for x, o in got if x == k), reverse=True)[:20] for k in want} == want


def test_no_expiry_before_its_time(spark):
    _, live = changes_of(spark, [[("a", minute(0), 1, False, "a")], [("b", minute(49), 2, False, "b")]])
    assert live == {"a": "a", "b": "b"}   # the clock stands at 29


def test_deadband_state_lasts_across_batches(spark):
    rows = history(spark, SF_SMALL).select("icao24", "time", "event_id", "latitude", "longitude")
    coarse = rows.withColumn("latitude", F.round("latitude", -1)).withColumn("longitude", F.round("longitude", -2))
    stream = streams_q._feed(spark, streams_q.land_in_time(coarse, "time", batches=7), coarse.schema)
    got = streams_q._end_of(ST.moved_points(stream, 0.001), "deadband", "append").drop("batch_id")
    want = G.deadband(coarse, 0.001)
    assert spark_rows(got.select(*want.columns)) == spark_rows(want)


def test_state_table_pointer(spark):
    """Two versions stay, a replayed batch starts from the same version, an old one changes nothing."""
    root = shared_dir(spark, "state")
    schema = "icao24 string, time timestamp_ntz, offset bigint, v string"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert S.read_state(spark, root) is None
    for i in range(4):
        for _ in range(2 if i == 2 else 1):
            S.state_table_write(batch(("a", minute(i % 3), i, f"a{i}"), (f"k{i}", T0, i, "k"), ("", T0, i, "x")), root, i)
    S.state_table_write(batch(("zz", T0, 1, "never")), root, 1)
    assert {r.icao24: r.v for r in S.read_state(spark, root).collect()} == {"a": "a2", "k0": "k", "k1": "k", "k2": "k", "k3": "k"}
    assert read_pointer(spark, root) == {"version": 3, "previous": 2}
    assert sorted(x for x in os.listdir(root.removeprefix("file:")) if x.startswith("v=")) == ["v=2", "v=3"]


def test_history_files_are_bounded_by_the_dates(spark):
    root = shared_dir(spark, "history")
    rows = history(spark, SF_SMALL).filter("time < TIMESTAMP_NTZ '2024-01-04'").cache()
    n = rows.count()
    for i in range(100):
        part = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(100)) == i)
        H.append_batch(part, root, i, partitions=1)
        if i in (40, 99):
            H.append_batch(part, root, i, partitions=1)  # replayed
    H.append_batch(rows.filter("false"), root, 3, partitions=1)  # long merged
    back = H.read_history(spark, root)
    assert back.count() == n and len(back.inputFiles()) <= 3 * (H.MOST_SEGMENTS + 1)
    assert spark_rows(back.drop("date")) == spark_rows(rows.select(*[c for c in back.columns if c != "date"]))
    on_disk = sum(f.endswith(".parquet") for _, _, fs in os.walk(root.removeprefix("file:")) for f in fs)
    assert on_disk <= 2 * 3 * (H.MOST_SEGMENTS + 1)


def test_retention_removes_the_folders(spark):
    root = shared_dir(spark, "history")
    rows = history(spark, SF_SMALL)
    for i in range(3):
        H.append_batch(rows.filter(F.col("event_id") % 3 == i), root, i)
    gone = H.retain(spark, root, "2024-01-31 00:00:00", "7 days")
    kept = rows.filter("time >= TIMESTAMP_NTZ '2024-01-24'")
    assert gone and H.read_history(spark, root).count() == kept.count()
    left = {d for d in os.listdir(root.removeprefix("file:") + "/data") if d.startswith("date=")}
    assert left == {f"date=2024-01-{d}" for d in range(24, 32)} & left and min(left) == "date=2024-01-24"
    assert H.retain(spark, root, "2024-01-31 00:00:00", "7 days") == []
    H.append_batch(rows.filter("time < TIMESTAMP_NTZ '2024-01-02'"), root, 3)  # a late row opens its date again
    assert H.expired_dates(spark, root, "2024-01-31 00:00:00", "7 days") == ["2024-01-01"]


def test_alert_ticks_mail_once(spark):
    got = streams_q.stream_alert_ticks(spark, SF_SMALL)
    assert got.count() == got.select("icao24", "email", "created_at").distinct().count() > 0
    assert read_alerts(spark, shared_dir(spark, "nothing")) is None
