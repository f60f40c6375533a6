"""Landed-file scans, sinks and single-aircraft forms."""

import re

import pytest
import datetime as dt
import json
import os

from pyspark.sql import functions as F

from contrail.operators import clean as C
from contrail.operators import latest as L
from contrail.operators import routes as R
from contrail.operators import trails as T
from contrail.session import shared_dir
from contrail.sinks import alerts as KA
from contrail.sinks import history as H
from contrail.plans.trails_q import history
from tests._compare import spark_rows
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 31)


def _local(path: str) -> str:
    return path.replace("file:", "", 1) if path.startswith("file:") else path


def test_raw_poll_files(spark):
    d = _local(shared_dir(spark, "poll"))
    os.makedirs(d)
    docs = [
        {"ac": [{"hex": " ABC123", "flight": "DLH1 ", "lat": 50.1, "lon": 8.6, "alt_baro": 35000, "gs": 450},
                {"hex": "def456", "lat": 1, "lon": 2, "alt_baro": "ground"}]},
        {"ac": None},
        {"now": 1},
        {"ac": []},
    ]
    for i, doc in enumerate(docs):
        with open(os.path.join(d, f"poll-{i}.json"), "w") as f:
            json.dump(doc, f)
    raw = C.raw_poll_files(spark, d)
    assert raw.count() == 2
    ok = C.accepted(C.normalise(raw)).orderBy("icao24").collect()
    assert [r.icao24 for r in ok] == ["abc123", "def456"]
    assert ok[0].baro_altitude == 35000 * 0.3048 and ok[1].on_ground is True


def test_route_documents(spark):
    d = _local(shared_dir(spark, "routes"))
    os.makedirs(d)
    docs = [
        {"callsign": " DLH1 ", "flights": [
            {"actual_off": "2024-01-30T10:00:00Z", "actual_on": "2024-01-30T12:00:00Z", "status": "Landed",
             "origin": {"code_iata": "FRA", "city": "Frankfurt"}, "destination": {"code": "KJFK"}},
            {"actual_off": "2024-01-30T20:00:00Z", "status": "En Route / On Time",
             "origin": {"code_iata": "", "code": "EDDF"}, "destination": {"code_iata": "JFK", "name": "Kennedy"},
             "ident_iata": "", "ident": "DLH1", "departure_delay": 120}]},
        {"callsign": "AAL2"},
    ]
    with open(os.path.join(d, "docs.json"), "w") as f:
        f.write("\n".join(json.dumps(x) for x in docs))
    cands = R.candidate_documents(spark, d)
    assert cands.count() == 2
    best = R.pick_route(cands)
    route = R.flatten_route(R.project_route(best)).collect()
    assert len(route) == 1
    r = route[0]
    assert (r.callsign, r.origin_iata_code, r.destination_iata_code, r.flight_number) == ("DLH1", "EDDF", "JFK", "DLH1")
    assert (r.departure_delay, r.arrival_delay, r.origin_municipality) == (120, 0, "")


def test_keyed_full_flight_scan(spark):
    h = history(spark, SF_SMALL)
    one = T.full_flight_for(h, "000003".upper(), "2024-01-31 00:00:00")
    every = T.full_flight_points(h, "2024-01-31 00:00:00").filter(F.col("icao24") == "000003")
    assert spark_rows(one) == spark_rows(every)
    pieces = T.full_flight_document(one, "000003", max_points=2).orderBy("piece_start", "chunk").collect()
    assert sum(len(r.path) for r in pieces) == one.count() and max(len(r.path) for r in pieces) <= 2
    assert len({r.phase for r in pieces}) == 1 and pieces[0].phase in ("GROUND", "CLIMBING", "CRUISE", "DESCENDING")
    empty = T.full_flight_document(one.filter("false"), "zzz").collect()
    assert len(empty) == 1 and empty[0].path == [] and empty[0].phase == "CRUISE"
    root = shared_dir(spark, "hist-keyed")
    H.append_batch(h.withColumn("event_id", F.col("event_id")), root, 0)
    stored = H.read_history(spark, root).withColumn("event_id", F.lit(0).cast("bigint"))
    plan = T.full_flight_for(stored, "000003", "2024-01-31 00:00:00")._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(x.split("]")[0] for x in plan.split("PushedFilters:")[1:])
    assert "EqualTo(icao24,000003)" in pushed and "GreaterThan(time," in pushed
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ >= ", plan)


def test_history_sink_and_retention(spark):
    root = shared_dir(spark, "hist")
    h = history(spark, SF_SMALL)
    H.append_batch(h, root, 0)
    H.append_batch(h, root, 0)   # replay of the same batch: no duplicates
    back = H.read_history(spark, root)
    assert back.count() == h.count()
    dates = H.expired_dates(spark, root, "2024-01-31 00:00:00", "7 days")
    assert dates[0] == "2024-01-01" and dates[-1] == "2024-01-23"


def test_alert_sink_roundtrip(spark):
    root = shared_dir(spark, "alerts")
    a = spark.createDataFrame([("a@x.org", "000001", T0, T0 - dt.timedelta(hours=1))],
                              "email string, icao24 string, eta timestamp_ntz, created_at timestamp_ntz")
    KA.append_alerts(a, root, 1)
    KA.append_alerts(a, root, 1)
    assert KA.read_alerts(spark, root).count() == 1


def test_positions_message_filter(spark):
    snap = spark.createDataFrame([("abc", 1.0, 2.0)], "icao24 string, lat double, lon double")
    doc = L.positions_document(snap.select("icao24", "lat", "lon"), "2024-01-31 00:00:00").first().message
    other = json.dumps({"type": "heartbeat", "aircraft": []})
    msgs = spark.createDataFrame([(doc,), (other,), ("junk",)], "value string")
    rows = L.positions_messages_only(msgs).collect()
    assert [(r.icao24, r.lat, r.lon) for r in rows] == [("abc", 1.0, 2.0)]


def test_rolling_trail_rows_bucketed_equals_plain_and_brute_force(spark):
    obs = [("a", i, float(i), float(-i)) for i in range(30)] + [("b", 100 + i, 1.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(obs, "icao24 string, offset long, longitude double, latitude double")
    plain = T.rolling_trail_rows(df, 5, ("offset",))
    split = T.rolling_trail_rows(df, 5, ("offset",), bucket=F.floor(F.col("offset") / 4))
    assert spark_rows(plain) == spark_rows(split)
    got = {(r.icao24, r.offset): r.trail for r in split.collect()}
    for k, off, lon, lat in obs:
        prev = [(o, lo, la) for kk, o, lo, la in obs if kk == k and o <= off][-5:]
        assert got[(k, off)] == [[lo, la] for _, lo, la in prev]


def test_path_pieces_reassemble(spark):
    h = history(spark, SF_SMALL)
    pts = T.full_flight_points(h, "2024-01-31 00:00:00", "30 days", "30 days")
    pieces = T.path_pieces(pts, max_points=3).collect()
    assert max(len(r.path) for r in pieces) <= 3
    by_key = {}
    for r in sorted(pieces, key=lambda r: (r.icao24, r.piece_start, r.chunk)):
        by_key.setdefault(r.icao24, []).extend(r.path)
    want = {}
    for r in pts.orderBy("icao24", "time", "event_id").collect():
        want.setdefault(r.icao24, []).append([r.lon, r.lat])
    assert by_key == want


def test_ingest_counters_observed_in_flight(spark):
    from pyspark.sql import Observation

    from contrail.sources.standins import raw_aircraft
    from contrail.sources.tables import table

    norm = C.normalise(raw_aircraft(table(spark, SF_SMALL, "events")))
    obs = Observation("ingest")
    C.observe_counters(norm, (24.0, 50.0, -125.0, -66.0), obs).write.format("noop").mode("overwrite").save()
    counts = {r.outcome: r.n for r in C.ingest_counters(norm, (24.0, 50.0, -125.0, -66.0)).collect()}
    assert obs.get["published"] == counts["published"]
    assert obs.get["skipped"] == sum(counts.values()) - counts["published"]


def test_dimension_files(spark):
    from contrail.operators import dims as D

    d = _local(shared_dir(spark, "dims"))
    os.makedirs(d)
    with open(os.path.join(d, "airlines.csv"), "w") as f:
        f.write("prefix,name,iata\nDLH,Lufthansa,LH\nXX,Example Air,XX\n")
    with open(os.path.join(d, "aircraft.csv"), "w") as f:
        f.write("icao24,registration,model,airline,updated_at\nabc123,D-AIXA,A350,DLH,2024-01-30 00:00:00\n")
    airlines = D.read_dimension(spark, os.path.join(d, "airlines.csv"), D.AIRLINE_SCHEMA)
    states = spark.createDataFrame([("abc123", " dlh400 "), ("def456", "XX12"), ("ghi789", "ANZ1"), ("jkl000", None)],
                                   "icao24 string, callsign string")
    got = {r.icao24: r.airline_name for r in D.airline_lookup(states, airlines).collect()}
    assert got == {"abc123": "Lufthansa", "def456": "Example Air", "ghi789": None, "jkl000": None}
    dim = D.read_dimension(spark, os.path.join(d, "aircraft.csv"), D.AIRCRAFT_DIM_SCHEMA)
    joined = {r.icao24: r.registration for r in D.enrich_aircraft(states, dim).collect()}
    assert joined["abc123"] == "D-AIXA" and joined["def456"] is None


def test_positions_document_pages(spark):
    snap = spark.range(23).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("icao24"),
                                  F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    docs = L.positions_document(snap, "2024-01-31 00:00:00", page_size=5).collect()
    parsed = [json.loads(d.message) for d in docs]
    assert {p["pages"] for p in parsed} == {5} and all(p["count"] == 23 for p in parsed)
    ids = sorted(a["icao24"] for p in parsed for a in p["aircraft"])
    assert ids == [f"{i:06d}" for i in range(23)]
    back = L.positions_messages_only(spark.createDataFrame([(d.message,) for d in docs], "value string"))
    assert back.count() == 23


def test_wire_files_of_one_key_stay_together(spark):
    """K1: what the file writer lands is what a stream of the topic reads."""
    from contrail.sinks.wire import to_wire, write_json_files

    root = shared_dir(spark, "wire-files")
    h = history(spark, SF_SMALL)
    for half in (0, 1):
        write_json_files(h.filter(F.col("event_id") % 2 == half), root, partitions=4)
    back = spark.read.schema("key string, value string").json(root)
    assert spark_rows(back) == spark_rows(to_wire(h))
    files = back.withColumn("f", F.input_file_name()).groupBy("key").agg(F.count_distinct("f").alias("n"))
    assert files.filter("n > 2").count() == 0  # one file of each of the two writes


def test_airline_keys_that_cannot_match_are_an_error(spark):
    from contrail.operators import dims as D

    flights = spark.createDataFrame([("dlh12 ",), (None,)], "callsign string")
    good = spark.createDataFrame([(" dlh", "Lufthansa", "LH"), (None, "x", "x")], "prefix string, name string, iata string")
    assert [r.airline_iata for r in D.airline_lookup(flights, good).orderBy("callsign").collect()] == [None, "LH"]
    bad = spark.createDataFrame([("D\u00dc", "x", "x")], "prefix string, name string, iata string")
    with pytest.raises(Exception, match="airline key"):
        D.airline_lookup(flights, bad).collect()
