"""Literal boundary tables for every rule with an edge (expected values are
derived from the reference's behaviour, with the reference's own durations)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contrail.functions import display as Dp
from contrail.functions.numeric import round_half_up, safe_number
from contrail.functions.phase import flight_phase
from contrail.functions.time import ntz, time_until_label
from contrail.operators import alerts as A
from contrail.operators import clean as C
from contrail.operators import geo as G
from contrail.operators import latest as L
from contrail.operators import routes as R
from contrail.operators import trails as T
from contrail.operators.tracking import distinct_tracked

AS_OF = "2024-01-31 00:00:00"
T0 = dt.datetime(2024, 1, 31)


def ago(**kw):
    return T0 - dt.timedelta(**kw)


def test_phase_rule_edges(spark):
    rows = [
        (False, 2.0, 9999.9, "CRUISE"), (False, 2.01, 9999.9, "CLIMBING"), (False, 2.01, 10000.0, "CRUISE"),
        (False, -2.0, 9999.9, "CRUISE"), (False, -2.01, 9999.9, "DESCENDING"), (False, -2.01, 10000.0, "CRUISE"),
        (False, None, 5000.0, "CRUISE"), (False, 5.0, None, "CRUISE"), (None, 5.0, 100.0, "CLIMBING"),
        (True, 9.0, 100.0, "GROUND"),
    ]
    df = spark.createDataFrame(rows, "on_ground boolean, vertical_rate double, baro_altitude double, want string")
    got = df.select(flight_phase().alias("p"), "want").collect()
    assert [r.p for r in got] == [r.want for r in got]


def test_phase_alternative_rule(spark):
    rows = [(None, None, None, "CRUISE"), (False, 1.5, 20000.0, "CLIMBING"), (False, -1.5, None, "DESCENDING"),
            (False, 1.0, 0.0, "CRUISE"), (True, -5.0, 0.0, "GROUND")]
    df = spark.createDataFrame(rows, "on_ground boolean, vertical_rate double, baro_altitude double, want string")
    rule = flight_phase(climb=1.0, descend=-1.0, ceiling=None, null_rate_as_zero=True)
    got = df.select(rule.alias("p"), "want").collect()
    assert [r.p for r in got] == [r.want for r in got]


def test_safe_number_matches_python_float(spark):
    texts = ["1.5", " 2 ", "\t3\n", "1e5", ".5", "5.", "+3", "-4", "1_000", "1__0", "_1", "1.5d", "abc", "",
             "nan", "-inf", "Infinity", "0x10", "1 2", None]

    def py(s):
        try:
            return float(s) if s is not None else None
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(safe_number(F.col("t")).alias("v")).collect()]
    for t, g in zip(texts, got):
        want = py(t)
        if want is not None and want != want:
            assert g != g, t
        else:
            assert g == want, t


def _raw(spark, rows):
    cols = ["event_id", "hex", "flight", "lat", "lon", "alt_baro", "alt_geom", "gs", "baro_rate", "track",
            "squawk", "category"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'event_id' else 'string'}" for c in cols))


def test_clean_reject_reasons_and_units(spark):
    base = ["ABC123", "DLH1  ", "10.0", "20.0", "1000", "1100", "100", "640", "90", "7000", "A3"]
    rows = [
        (1, *base),
        (2, "", *base[1:]),                                   # blank hex
        (3, None, *base[1:]),                                 # missing hex
        (4, base[0], base[1], None, *base[3:]),               # missing lat
        (5, base[0], base[1], "nan", *base[3:]),              # NaN lat: kept, serialises as null
        (6, base[0], base[1], base[2], base[3], "ground", *base[5:]),
        (7, base[0], base[1], base[2], base[3], None, *base[5:]),
        (8, base[0], base[1], base[2], base[3], "n/a", *base[5:]),   # bad alt_baro drops
        (9, base[0], base[1], base[2], base[3], base[4], "bad", *base[6:]),  # bad alt_geom only nulls
        (10, base[0], "   ", *base[2:]),                       # blank callsign -> null
        (11, "\t abc123 ", *base[1:]),                         # tab around hex
        (12, base[0], base[1], "1.5d", *base[3:]),            # Spark-only syntax is rejected
        (13, base[0], base[1], base[2], base[3], base[4], base[5], "1_0", *base[7:]),
    ]
    n = C.normalise(_raw(spark, rows))
    got = {r.event_id: r for r in n.collect()}
    assert got[1].reject_reason is None and got[1].icao24 == "abc123" and got[1].callsign == "DLH1"
    assert got[1].baro_altitude == pytest.approx(1000 * 0.3048) and got[1].geo_altitude == pytest.approx(1100 * 0.3048)
    assert got[1].velocity == pytest.approx(100 * 0.514444) and got[1].vertical_rate == pytest.approx(640 * 0.00508)
    assert got[2].reject_reason == "missing_hex" and got[3].reject_reason == "missing_hex"
    assert got[4].reject_reason == "bad_position"
    assert got[5].reject_reason is None and got[5].latitude is None
    assert got[6].on_ground is True and got[6].baro_altitude is None and got[6].reject_reason is None
    assert got[7].on_ground is False and got[7].baro_altitude is None and got[7].reject_reason is None
    assert got[8].reject_reason == "bad_alt_baro"
    assert got[9].reject_reason is None and got[9].geo_altitude is None
    assert got[10].callsign is None
    assert got[11].icao24 == "abc123"
    assert got[12].reject_reason == "bad_position"
    assert got[13].velocity == pytest.approx(10 * 0.514444)


def test_box_edges(spark):
    box = (24.0, 50.0, -125.0, -66.0)
    rows = [(24.0, -125.0, True), (50.0, -66.0, True), (24.0, -66.0, True), (50.0, -125.0, True),
            (23.999, -100.0, False), (30.0, -65.999, False), (None, -100.0, False), (float("nan"), -100.0, False)]
    df = spark.createDataFrame(rows, "lat double, lon double, want boolean")
    got = df.select(C.within_box(F.col("lat"), F.col("lon"), box).alias("b"), "want").collect()
    assert [r.b for r in got] == [r.want for r in got]


def test_staleness_edges(spark):
    def iso(t, suffix=""):
        return t.strftime("%Y-%m-%dT%H:%M:%S.%f") + suffix

    rows = [
        ("a", iso(ago(seconds=119.999)), None, True),
        ("b", iso(ago(seconds=120)), None, True),
        ("c", iso(ago(seconds=120.001)), None, False),
        ("d", None, None, True),
        ("e", "junk", None, True),
        ("f", iso(ago(minutes=5)), None, False),              # zone-less = UTC
        ("g", iso(ago(minutes=1), "Z"), None, True),
        ("h", iso(ago(minutes=3), "+00:00"), None, False),
        ("i", "", iso(ago(minutes=1)), True),                 # empty -> falls back to time
        ("j", "", iso(ago(minutes=10)), False),
        ("k", iso(ago(minutes=1), "+01:00"), None, False),    # offset honoured: 61 min old
    ]
    df = spark.createDataFrame(rows, "icao24 string, ingested_at string, time string, want boolean")
    kept = {r.icao24 for r in L.fresh_only(df, AS_OF, "2 minutes").collect()}
    assert kept == {r[0] for r in rows if r[3]}


def _hist(spark, rows):
    return spark.createDataFrame(
        rows, "icao24 string, time timestamp_ntz, event_id long, latitude double, longitude double, flight_phase string")


def test_latest_ties_and_null_keys(spark):
    df = spark.createDataFrame(
        [("a", T0, 1, 10), ("a", T0, 2, 5), ("b", ago(hours=1), 3, 99), ("b", ago(hours=2), 4, 100),
         (None, T0, 5, 1), ("", T0, 6, 1)],
        "icao24 string, time timestamp_ntz, event_id long, offset long")
    by_time = {r.icao24: r.event_id for r in L.latest_per_key(df, "icao24", ("time", "event_id")).collect()}
    assert by_time == {"a": 2, "b": 3}
    by_arrival = {r.icao24: r.event_id for r in L.latest_per_key(df, "icao24", ("offset",)).collect()}
    assert by_arrival == {"a": 1, "b": 4}  # a late row with a higher offset wins in arrival order


def test_first_non_empty_source(spark):
    schema = "icao24 string"
    one = spark.createDataFrame([("h",)], schema)
    empty = spark.createDataFrame([], schema)
    cold = spark.createDataFrame([("c1",), ("c2",)], schema)
    assert sorted(r.icao24 for r in L.first_non_empty_source(empty, cold).collect()) == ["c1", "c2"]
    assert [r.icao24 for r in L.first_non_empty_source(one, cold).collect()] == ["h"]
    assert L.first_non_empty_source(empty, empty).count() == 0


def test_full_flight_edges(spark):
    G_, C_, CR = "GROUND", "CLIMBING", "CRUISE"
    rows = [
        # a: first row of the 48 h window is airborne -> it is the take-off
        ("a", ago(hours=40), 1, 1.0, 1.0, CR), ("a", ago(hours=30), 2, 1.0, 2.0, CR),
        # b: ground -> airborne twice -> the newer one
        ("b", ago(hours=40), 3, 1.0, 1.0, G_), ("b", ago(hours=39), 4, 1.0, 1.0, C_),
        ("b", ago(hours=20), 5, 1.0, 1.0, G_), ("b", ago(hours=19), 6, 1.0, 1.0, C_), ("b", ago(hours=1), 7, 1.0, 1.0, CR),
        # c: all ground -> 24 h default
        ("c", ago(hours=40), 8, 1.0, 1.0, G_), ("c", ago(hours=10), 9, 1.0, 1.0, G_),
        # d: take-off older than 48 h: the first row inside the window counts
        ("d", ago(hours=50), 10, 1.0, 1.0, G_), ("d", ago(hours=49), 11, 1.0, 1.0, C_), ("d", ago(hours=30), 12, 1.0, 1.0, CR),
        # e: null phase never qualifies, but is a null predecessor
        ("e", ago(hours=40), 13, 1.0, 1.0, G_), ("e", ago(hours=39), 14, 1.0, 1.0, None), ("e", ago(hours=38), 15, 1.0, 1.0, CR),
        # f: null position is not a point
        ("f", ago(hours=5), 16, None, 1.0, CR), ("f", ago(hours=4), 17, 1.0, 1.0, CR),
    ]
    h = _hist(spark, rows)
    for bucket in (None, T.hourly()):
        to = {r.icao24: r.takeoff_time for r in T.last_takeoff(h, AS_OF, "48 hours", bucket).collect()}
        assert to == {"a": ago(hours=40), "b": ago(hours=19), "d": ago(hours=30), "e": ago(hours=38), "f": ago(hours=5)}
        pts = T.full_flight_points(h, AS_OF, "48 hours", "24 hours", bucket).collect()
        ids = sorted(r.event_id for r in pts)
        assert ids == [1, 2, 6, 7, 9, 12, 15, 17]


def test_trail_assembly(spark):
    rows = [("one", ago(minutes=1), 1, 1.0, 1.0, "CRUISE")]
    rows += [("many", ago(minutes=i), 100 + i, float(i), float(-i), "CLIMBING" if i else "CRUISE") for i in range(16)]
    rows += [("gap", ago(minutes=3), 200, 1.0, 1.0, "CRUISE"), ("gap", ago(minutes=2), 201, None, 2.0, "CRUISE"),
             ("gap", ago(minutes=1), 202, 3.0, 3.0, "DESCENDING")]
    pts = T.recent_trail_points(_hist(spark, rows), AS_OF, "15 minutes", 15, ordered=False)
    paths = {r.icao24: r for r in T.trail_paths(pts).collect()}
    assert "one" not in paths
    assert len(paths["many"].path) == 15          # strictly newer than 15 min: minutes 0..14 of 0..15
    assert paths["many"].phase == "CRUISE" and paths["many"].path[-1] == [-0.0, 0.0]
    wide = T.recent_trail_points(_hist(spark, rows), AS_OF, "20 minutes", 15, ordered=False)
    capped = {r.icao24: r for r in T.trail_paths(wide).collect()}["many"]
    assert len(capped.path) == 15 and capped.path[0] == [-14.0, 14.0]   # the oldest of 16 is cut
    assert paths["gap"].path == [[1.0, 1.0], [3.0, 3.0]] and paths["gap"].phase == "DESCENDING"


def test_route_priorities(spark):
    sch = ("callsign string, pos long, actual_off string, actual_on string, status string, "
           "origin struct<code_iata:string,code:string,city:string,name:string>, "
           "destination struct<code_iata:string,code:string,city:string,name:string>")
    o = ("AAA", "KAAA", "A", "Alpha")
    rows = [
        ("P1", 0, None, None, "Scheduled", o, o), ("P1", 1, "2024-01-01T10:00Z", None, "x", o, o),
        ("P1", 2, "2024-01-01T11:00Z", "", "x", o, o),                      # also priority 1, later
        ("P2", 0, None, None, "Scheduled", o, o), ("P2", 1, None, None, "En Route / Delayed", o, o),
        ("P3", 0, "2024-01-01T10:00Z", "2024-01-01T12:00Z", "Landed", o, o),
        ("P3", 1, "2024-01-01T11:00Z", "2024-01-01T13:00Z", "Landed", o, o),
        ("P3", 2, "2024-01-01T11:00Z", "2024-01-01T14:00Z", "Landed", o, o),  # tie -> first
        ("NONE", 0, None, None, None, o, o),                                 # null status: no match
        ("NOORIG", 0, "2024-01-01T10:00Z", None, "x", None, o),
    ]
    best = {r.callsign: r for r in R.pick_route(spark.createDataFrame(rows, sch)).collect()}
    assert (best["P1"].pos, best["P1"].priority) == (1, 1)
    assert (best["P2"].pos, best["P2"].priority) == (1, 2)
    assert (best["P3"].pos, best["P3"].priority) == (1, 3)
    assert "NONE" not in best
    assert best["NOORIG"].valid is False


def _routes(spark, eta_rows):
    sch = ("callsign string, flight_number string, estimated_on string, scheduled_on string, actual_on string, "
           "origin struct<iata_code:string,municipality:string,name:string>, "
           "destination struct<iata_code:string,municipality:string,name:string>")
    ap = ("AAA", "A", "Alpha")
    return spark.createDataFrame([(cs, fn, e, s, a, ap, ap) for cs, fn, e, s, a in eta_rows], sch)


def test_alert_window_edges(spark):
    def at(minutes):
        return (T0 + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")

    routes = _routes(spark, [
        ("M0", "", at(0), None, None), ("M05", None, at(0.5), None, None), ("M65", "LH65", at(65), None, None),
        ("M6501", None, at(65.01), None, None), ("NEG", None, at(-5), None, None),
        ("LANDED", None, at(10), None, "2024-01-30T23:00:00Z"), ("EMPTY", None, "", "", None),
        ("JUNK", None, "soon", None, None), ("SCHED", None, "", at(30), None), ("NOTIFIED", None, at(10), None, None),
    ])
    names = ["M0", "M05", "M65", "M6501", "NEG", "LANDED", "EMPTY", "JUNK", "SCHED", "NOTIFIED"]
    subs = spark.createDataFrame(
        [(f"{n.lower()}@x.org", f"{i:06d}", f" {n} ", n == "NOTIFIED", ago(hours=1), T0 + dt.timedelta(hours=23))
         for i, n in enumerate(names)],
        "email string, icao24 string, callsign string, notified boolean, created_at timestamp_ntz, expires_at timestamp_ntz")
    live = spark.createDataFrame([], "icao24 string, callsign string")
    got = {r.callsign: r for r in A.due_alerts(subs, live, routes, AS_OF, 65).collect()}
    assert set(got) == {"M05", "M65", "SCHED"}
    assert got["M05"].minutes == 0 and got["M65"].minutes == 65 and got["SCHED"].minutes == 30
    assert got["M65"].flight_number == "LH65" and got["M05"].flight_number == "M05"


def test_callsign_fallback_to_live(spark):
    routes = _routes(spark, [("LIVE1", None, (T0 + dt.timedelta(minutes=10)).isoformat(), None, None)])
    subs = spark.createDataFrame(
        [("a@x.org", "000001", "  ", False, ago(hours=1), T0 + dt.timedelta(hours=1)),
         ("b@x.org", "000002", "", False, ago(hours=1), T0 + dt.timedelta(hours=1))],
        "email string, icao24 string, callsign string, notified boolean, created_at timestamp_ntz, expires_at timestamp_ntz")
    live = spark.createDataFrame([("000001", " LIVE1 "), ("000002", None)], "icao24 string, callsign string")
    got = A.due_alerts(subs, live, routes, AS_OF, 65).collect()
    assert [(r.email, r.callsign) for r in got] == [("a@x.org", "LIVE1")]


def test_subscription_upsert_and_delete(spark):
    req = spark.createDataFrame([
        ("Ann@X.org", "ABC123", "DLH1", True, ago(hours=3), 1),
        ("ann@x.org", "abc123", "DLH1 ", False, ago(hours=1), 2),     # same key, other case: overwrites notified
        ("bad.example.org", "abc123", "DLH1", False, ago(hours=1), 3),  # no @: rejected
        ("bob@x.org", "def456", "", False, ago(hours=30), 4),          # expired
    ], "email string, icao24 string, callsign string, notified boolean, created_at timestamp_ntz, seq long")
    subs = A.upsert_subscriptions(req, "24 hours")
    rows = {(r.icao24, r.email.lower()): r for r in subs.collect()}
    assert set(rows) == {("abc123", "ann@x.org"), ("def456", "bob@x.org")}
    assert rows[("abc123", "ann@x.org")].notified is False and rows[("abc123", "ann@x.org")].callsign == "DLH1"
    assert A.active_subscriptions(subs, AS_OF).count() == 1
    dels = spark.createDataFrame([("ABC123", "ANN@X.ORG"), ("zzz999", "nobody@x.org")], "icao24 string, email string")
    assert [r.icao24 for r in A.delete_subscriptions(subs, dels).collect()] == ["def456"]


def test_fire_once(spark):
    routes = _routes(spark, [("CS1", None, (T0 + dt.timedelta(minutes=10)).isoformat(), None, None)])
    subs = spark.createDataFrame(
        [("a@x.org", "000001", "CS1", False, ago(hours=1), T0 + dt.timedelta(minutes=30))],
        "email string, icao24 string, callsign string, notified boolean, created_at timestamp_ntz, expires_at timestamp_ntz")
    live = spark.createDataFrame([], "icao24 string, callsign string")
    fired = A.due_alerts(subs, live, routes, AS_OF)
    assert fired.count() == 1
    assert A.due_alerts(subs, live, routes, AS_OF, fired=fired).count() == 0
    after = A.mark_notified(subs, fired, AS_OF).collect()[0]
    assert after.notified is True and after.expires_at == T0 + dt.timedelta(hours=1)
    assert A.due_alerts(A.mark_notified(subs, fired, AS_OF), live, routes, AS_OF).count() == 0


def test_display_edges(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-0.5,), (0.49,)], "x double")
    assert [r.v for r in df.select(round_half_up(F.col("x")).alias("v")).collect()] == [-2, 3, 0, 0]
    delays = spark.createDataFrame([(0,), (None,), (1,), (29,), (30,), (-30,), (-90,)], "s int")
    labels = [r.v for r in delays.select(Dp.delay_label(F.col("s")).alias("v")).collect()]
    assert labels == ["On time", "On time", "0 min early", "0 min early", "+1 min late", "0 min early", "1 min early"]
    etas = spark.createDataFrame([(T0,), (T0 + dt.timedelta(seconds=29),), (T0 + dt.timedelta(seconds=59),),
                                  (T0 + dt.timedelta(minutes=60),), (T0 + dt.timedelta(minutes=125),), (None,)],
                                 "eta timestamp_ntz")
    got = [r.v for r in etas.select(time_until_label(F.col("eta"), ntz(AS_OF)).alias("v")).collect()]
    assert got == ["Arriving", "0m", "1m", "1h 0m", "2h 5m", None]
    cats = spark.createDataFrame([("A7",), ("B2",), ("B1",), ("B6",), ("A3",), (None,)], "c string")
    assert [r.v for r in cats.select(Dp.category_class(F.col("c")).alias("v")).collect()] == [
        "helicopter", "balloon", "glider", "drone", "plane", "plane"]
    alt = spark.createDataFrame([(True, 20000.0), (False, 10000.1), (False, 10000.0), (False, 5000.0), (False, None)],
                                "g boolean, a double")
    assert [r.v for r in alt.select(Dp.altitude_band(F.col("g"), F.col("a")).alias("v")).collect()] == [
        "ground", "high", "mid", "low", "low"]
    names = spark.createDataFrame([("", " DLH1 ", "abc"), (None, "  ", "abc"), ("LH1", "DLH1", "abc")],
                                  "fn string, cs string, id string")
    assert [r.v for r in names.select(Dp.display_name(F.col("fn"), F.col("cs"), F.col("id")).alias("v")).collect()] == [
        "DLH1", "ABC", "LH1"]


def test_geometry_edges(spark):
    rows = [("n", T0, 1, 0.0, 0.0, "C"), ("n", T0 + dt.timedelta(seconds=1), 2, 1.0, 0.0, "C"),
            ("e", T0, 3, 0.0, 0.0, "C"), ("e", T0 + dt.timedelta(seconds=1), 4, 0.0, 1.0, "C"),
            ("s", T0, 5, 1.0, 0.0, "C"), ("s", T0 + dt.timedelta(seconds=1), 6, 0.0, 0.0, "C"),
            ("w", T0, 7, 0.0, 1.0, "C"), ("w", T0 + dt.timedelta(seconds=1), 8, 0.0, 0.0, "C"),
            ("z", T0, 9, 5.0, 5.0, "C"), ("z", T0 + dt.timedelta(seconds=1), 10, 5.0, 5.0, "C")]
    segs = {r.icao24: r for r in G.segments(_hist(spark, rows)).collect()}
    assert {k: round(v.bearing, 9) for k, v in segs.items()} == {"n": 0.0, "e": 90.0, "s": 180.0, "w": 270.0, "z": 0.0}
    assert segs["z"].seg_len == 0.0


def test_interpolation_progress(spark):
    # an L-shaped path: (0,0) -> (0,3) -> (4,3); length 3 + 4 = 7
    rows = [("a", T0 + dt.timedelta(seconds=i), i, lat, lon, "C") for i, (lat, lon) in enumerate([(0, 0), (0, 3), (4, 3)])]
    h = _hist(spark, [(a, t, e, float(la), float(lo), p) for a, t, e, la, lo, p in rows])
    lengths = G.path_lengths(G.segments(h))
    got = {r.fraction: r for r in G.interpolate_along(lengths, [0.0, 3 / 7, 1.0], bucket_width=1.0).collect()}
    assert (got[0.0].lat, got[0.0].lon, got[0.0].segment_end_event) == (0.0, 0.0, 1)
    assert got[3 / 7].segment_end_event == 1 and got[3 / 7].lon == pytest.approx(3.0)   # at the joint: first segment
    assert (got[1.0].lat, got[1.0].lon, got[1.0].segment_end_event) == (4.0, 3.0, 2)
    assert got[1.0].heading == pytest.approx(0.0, abs=1e-9)


def test_deadband_accumulates(spark):
    rows = [("a", T0 + dt.timedelta(seconds=i), i, 0.0, round(0.0004 * i, 6), "C") for i in range(7)]
    kept = sorted(r.event_id for r in G.deadband(_hist(spark, rows), 0.001).collect())
    assert kept == [0, 3, 6]   # lag-based thresholding would keep only the first point


def test_distinct_tracked_order(spark):
    acts = spark.createDataFrame(
        [(0, "track", "000003"), (1, "track", "000001"), (2, "track", "000003"), (3, "track", "000140"),
         (4, "track", "999999"), (5, "untrack", "000001"), (6, "track", "000001")],
        "seq long, action string, icao24 string")
    got = sorted((r.position, r.icao24) for r in distinct_tracked(acts).collect())
    assert got == [(0, "000003"), (3, "000140"), (4, "999999"), (6, "000001")]
