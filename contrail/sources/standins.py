"""Stand-in inputs derived from the given tables.

The reference reads live feeds and key-value stores; the test data are
generic tables. Each function here maps a given table onto one of the
reference's input shapes with plain column expressions (no shuffle, no
driver work), so every query's work grows with the data. The same mapping is
written in SQL in contrail.plans.oracle for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.functions.phase import flight_phase
from contrail.functions.time import ntz

# Fixed values of the stand-in mapping (FIXTURES.md B).
AS_OF = "2024-01-31 00:00:00"
CALLSIGN_PREFIX = {0: "DLH", 1: "AAL", 2: "ANZ", 3: "XX"}          # user_id % 5; 4 -> no callsign
ROUTE_CALLSIGN_PREFIX = {0: "DLH", 1: "AAL", 2: "ANZ", 3: "XX", 4: "SWA"}  # every owner files routes
VERTICAL_RATE = {"click": 5.0, "error": -6.0, "view": 0.2, "purchase": 0.0}  # signup -> null
CATEGORY = {0: "A3", 1: "A7", 2: "B1", 3: "B2", 4: "B6"}              # event_id % 6; 5 -> null
ORDER_STATUS = {"O": "Scheduled", "P": "En Route / On Time", "F": "Landed"}
BARO_RATE_FTMIN = {"click": "1000", "error": "-1200", "view": "40", "purchase": "0"}


def _case(key: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v)))
    return out


def icao_of(user_id: Column) -> Column:
    return F.lpad(user_id.cast("string"), 6, "0")


def callsign_of(user_id: Column, prefixes: dict = CALLSIGN_PREFIX) -> Column:
    return F.concat(_case(user_id % 5, prefixes), F.lpad(user_id.cast("string"), 4, "0"))


def _position_missing(event_id: Column) -> Column:
    return event_id % 17 == 0


def _lat(event_id: Column) -> Column:
    return F.when(~_position_missing(event_id),
                  ((event_id * 7919) % 18000).cast("double") / F.lit(100.0) - F.lit(90.0))


def _lon(event_id: Column) -> Column:
    return F.when(~_position_missing(event_id),
                  ((event_id * 104729) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0))


def flight_states(events: DataFrame) -> DataFrame:
    """History rows (`flight_states`) from `events`; `event_id` is the tie-break."""
    e, u, t, v = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    alt = F.when(t != "purchase", v * F.lit(40.0))
    vr = _case(t, VERTICAL_RATE).cast("double")
    og = t == "purchase"
    return events.select(
        F.col("ts").alias("time"),
        icao_of(u).alias("icao24"),
        callsign_of(u).alias("callsign"),
        _lat(e).alias("latitude"),
        _lon(e).alias("longitude"),
        alt.alias("baro_altitude"),
        F.when(t != "purchase", v * F.lit(41.0)).alias("geo_altitude"),
        (v * F.lit(3.0)).alias("velocity"),
        ((e * 31) % 360).cast("double").alias("true_track"),
        vr.alias("vertical_rate"),
        og.alias("on_ground"),
        flight_phase(og, vr, alt).alias("flight_phase"),
        F.lpad((e % 7777).cast("string"), 4, "0").alias("squawk"),
        _case(e % 6, CATEGORY).alias("category"),
        F.col("ts").alias("ingested_at"),
        e.alias("event_id"),
    )


def raw_aircraft(events: DataFrame) -> DataFrame:
    """Raw poll aircraft objects (all leaves text) with every kind of defect."""
    e, u, t, v = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    up = F.upper(icao_of(u))
    hex_ = (F.when(e % 101 == 0, F.lit("  "))
            .when(e % 127 == 0, F.concat(F.lit("\t"), up, F.lit(" ")))
            .otherwise(F.concat(F.lit(" "), up)))
    lat = (F.when(e % 103 == 0, F.lit("x"))
           .when(~_position_missing(e), F.concat(((e * 7919) % 18000 - 9000).cast("string"), F.lit("e-2"))))
    lon = (F.when(e % 211 == 0, F.lit("NaN"))
           .when(~_position_missing(e), F.concat(((e * 104729) % 36000 - 18000).cast("string"), F.lit("e-2"))))
    alt_baro = (F.when(t == "purchase", F.lit("ground"))
                .when(e % 107 == 0, F.lit("n/a"))
                .when(t != "signup", F.floor(v * F.lit(100.0)).cast("bigint").cast("string")))
    alt_geom = (F.when(e % 109 == 0, F.lit("bad"))
                .when(e % 113 == 0, F.lit("1_000"))
                .otherwise(F.floor(v * F.lit(110.0)).cast("bigint").cast("string")))
    return events.select(
        e.alias("event_id"),
        hex_.alias("hex"),
        F.concat(callsign_of(u), F.lit("  ")).alias("flight"),
        lat.alias("lat"),
        lon.alias("lon"),
        alt_baro.alias("alt_baro"),
        alt_geom.alias("alt_geom"),
        (e % 500).cast("string").alias("gs"),
        _case(t, BARO_RATE_FTMIN).alias("baro_rate"),
        (e % 360).cast("string").alias("track"),
        F.lpad((e % 7777).cast("string"), 4, "0").alias("squawk"),
        _case(e % 6, CATEGORY).alias("category"),
    )


def wire_rows(events: DataFrame) -> DataFrame:
    """Keyed wire messages as a Kafka source delivers them.

    key = icao24, value = the state as JSON text (nulls kept), partition by
    key, and an offset order that differs from event time so arrival order
    and event order disagree. Every 113th value is not JSON.
    """
    from contrail.sinks.wire import state_json  # local import: sinks depend on schema only

    fs = flight_states(events)
    state = fs.withColumn("ingested_at", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    value = F.when(F.col("event_id") % 113 == 0, F.lit("junk")).otherwise(state_json())
    return state.select(
        F.col("icao24").alias("key"),
        value.alias("value"),
        F.lit("raw-flights").alias("topic"),
        (F.col("icao24").try_cast("bigint") % 4).cast("int").alias("partition"),
        ((F.col("event_id") * 7919) % 10007 * F.lit(1_000_000_000) + F.col("event_id")).alias("offset"),
        F.col("time").alias("timestamp"),
        F.col("event_id"),
    )


def _iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def route_candidates(orders: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Flat route candidates (one per flight document entry) from `orders`."""
    k, c, st, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    u = F.floor(c / F.lit(10)).cast("bigint")
    cs = callsign_of(u, ROUTE_CALLSIGN_PREFIX)
    a = ntz(as_of)
    actual_off = F.when((st == "F") | ((st == "P") & (u % 3 != 1)), _iso_z(d))
    actual_on = F.when(st == "F", _iso_z(d + F.expr("INTERVAL 2 HOURS")))
    est = F.when(k % 11 == 0, F.lit("")).otherwise(
        _iso_z(a + F.make_dt_interval(mins=(k % 300 - 100).cast("int"))))
    sched = F.when((k % 11 == 0) | (k % 2 == 0),
                   _iso_z(a + F.make_dt_interval(mins=(k % 240 - 60).cast("int"))))
    code = F.lpad((c % 97).cast("string"), 3, "0")
    origin = F.when(k % 23 != 0, F.struct(
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("O"), F.substring(code, 2, 2))).alias("code_iata"),
        F.concat(F.lit("K"), code).alias("code"),
        F.concat(F.lit("City"), code).alias("city"),
        F.when(k % 13 != 0, F.concat(F.lit("Airport "), code)).alias("name"),
    ))
    dcode = F.lpad((k % 89).cast("string"), 3, "0")
    destination = F.struct(
        F.concat(F.lit("D"), F.substring(dcode, 2, 2)).alias("code_iata"),
        F.concat(F.lit("K"), dcode).alias("code"),
        F.when(k % 5 != 0, F.concat(F.lit("Town"), dcode)).alias("city"),
        F.concat(F.lit("Field "), dcode).alias("name"),
    )
    return (
        orders.select(
            cs.alias("callsign"),
            k.alias("pos"),
            actual_off.alias("actual_off"),
            actual_on.alias("actual_on"),
            est.alias("estimated_on"),
            sched.alias("scheduled_on"),
            _case(st, ORDER_STATUS).alias("status"),
            origin.alias("origin"),
            destination.alias("destination"),
            F.when(k % 13 != 0, ((k % 7 - 3) * 600).cast("int")).alias("departure_delay"),
            ((k % 9 - 4) * 15).cast("int").alias("arrival_delay"),
            F.when(k % 2 == 0, F.lit("A320")).otherwise(F.lit("B738")).alias("aircraft_type"),
            F.when(k % 3 == 0, F.lit("")).otherwise(
                F.concat(F.substring(cs, 1, 2), (k % 1000).cast("string"))).alias("ident_iata"),
            F.concat(cs, F.lit("-"), k.cast("string")).alias("ident"),
            (k % 3000).cast("int").alias("route_distance"),
            F.concat(F.lit("fa-"), k.cast("string")).alias("fa_flight_id"),
        )
    )


def subscription_requests(customer: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Subscribe requests in arrival order (`seq`), from `customer`.

    Every customer subscribes to its owner's aircraft; every 5th later
    re-subscribes with the same key in other letter case; every 13th also
    sends one malformed e-mail (no `@`).
    """
    c = F.col("c_custkey")
    u = F.floor(c / F.lit(10)).cast("bigint")
    icao = icao_of(u)
    email = F.concat(F.lit("u"), u.cast("string"), F.lit("c"), c.cast("string"), F.lit("@example.com"))
    a = ntz(as_of)
    created = a - F.make_dt_interval(hours=(c % 30).cast("int"))
    cs = F.when(c % 4 == 0, F.lit("  ")).otherwise(F.concat(callsign_of(u, ROUTE_CALLSIGN_PREFIX), F.lit(" ")))
    row = lambda email, icao, callsign, notified, created, seq: F.struct(
        email.alias("email"), icao.alias("icao24"), callsign.alias("callsign"), notified.alias("notified"), created.alias("created_at"), seq.alias("seq"))
    first = row(F.when(c % 2 == 0, F.upper(email)).otherwise(email), icao, cs, c % 7 == 0, created, c * 3)
    again = row(F.when(c % 2 == 0, email).otherwise(F.upper(email)), F.upper(icao), callsign_of(u, ROUTE_CALLSIGN_PREFIX), F.lit(False),
                created + F.expr("INTERVAL 30 MINUTES"), c * 3 + 1)
    bad = row(F.regexp_replace(email, "@", "."), icao, F.lit(""), F.lit(False), created, c * 3 + 2)
    sent = F.filter(F.array(first, F.when(c % 5 == 0, again), F.when(c % 13 == 0, bad)), lambda r: r.isNotNull())
    return customer.select(F.explode(sent).alias("r")).select("r.*")


def unsubscribe_requests(customer: DataFrame) -> DataFrame:
    """Deletes: every 9th customer drops its key (other letter case); every
    27th also deletes a key that never existed."""
    c = F.col("c_custkey")
    u = F.floor(c / F.lit(10)).cast("bigint")
    email = F.concat(F.lit("U"), u.cast("string"), F.lit("C"), c.cast("string"), F.lit("@EXAMPLE.COM"))
    real = customer.filter(c % 9 == 0).select(F.upper(icao_of(u)).alias("icao24"), email.alias("email"))
    ghost = customer.filter(c % 27 == 0).select(F.lit("ffffff").alias("icao24"), email.alias("email"))
    return real.unionByName(ghost)


def unsubscribe_log(customer: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The same deletes with a place in the order of events: 10 minutes after
    the first request, so every re-subscription comes later."""
    c = F.col("c_custkey")
    u = F.floor(c / F.lit(10)).cast("bigint")
    email = F.concat(F.lit("U"), u.cast("string"), F.lit("C"), c.cast("string"), F.lit("@EXAMPLE.COM"))
    at = ntz(as_of) - F.make_dt_interval(hours=(c % 30).cast("int")) + F.expr("INTERVAL 10 MINUTES")
    ids = F.when(c % 27 == 0, F.array(F.upper(icao_of(u)), F.lit("ffffff"))).otherwise(F.array(F.upper(icao_of(u))))
    return customer.filter(c % 9 == 0).select(F.explode(ids).alias("icao24"), email.alias("email"),
                                              at.alias("created_at"), (c * 3).alias("seq"))


def untimed(wire: DataFrame) -> DataFrame:
    """Wire messages of which every 101st has an unreadable and every 103rd no stamp."""
    stamp = r'"ingested_at":"[^"]*"'
    e = F.col("event_id")
    return wire.withColumn("value", F.when(e % 101 == 0, F.regexp_replace("value", stamp, '"ingested_at":"soon"'))
                           .when(e % 103 == 0, F.regexp_replace("value", stamp, '"ingested_at":null'))
                           .otherwise(F.col("value")))


def airports(supplier: DataFrame) -> DataFrame:
    """Airport dimension rows (iata, name, city, lon, lat, tier) from `supplier`."""
    s = F.col("s_suppkey")
    code = F.lpad(s.cast("string"), 3, "0")
    return supplier.select(
        F.concat(F.lit("S"), code).alias("iata"),
        F.concat(F.lit("Airport "), code).alias("name"),
        F.concat(F.lit("City"), (s % 40).cast("string")).alias("city"),
        ((s * 37) % 360 - 180).cast("double").alias("lon"),
        ((s * 53) % 180 - 90).cast("double").alias("lat"),
        (s % 3 + 1).cast("int").alias("tier"),
    )


def aircraft_dim(events: DataFrame) -> DataFrame:
    """Declared aircraft dimension: one row per even user id."""
    u = F.col("user_id")
    return (
        events.select("user_id").filter(u % 2 == 0).distinct()
        .select(
            icao_of(u).alias("icao24"),
            F.concat(F.lit("N"), u.cast("string")).alias("registration"),
            F.when(u % 3 == 0, F.lit("A320")).when(u % 3 == 1, F.lit("B738")).otherwise(F.lit("E190")).alias("model"),
            _case(u % 5, CALLSIGN_PREFIX).alias("airline"),
            ntz(AS_OF).alias("updated_at"),
        )
    )


# Own sample of the airline dimension (not the reference's table): two
# three-letter keys and one two-letter key; ANZ is left out on purpose.
AIRLINE_SAMPLE = [("DLH", "Lufthansa", "LH"), ("AAL", "American Airlines", "AA"), ("XX", "Example Air", "XX")]


def airlines_sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AIRLINE_SAMPLE, "prefix string, name string, iata string")


# Tracked ids in the order a user added them (3 twice, 999999 unknown).
TRACKED_SAMPLE = [3, 1, 3, 140, 999999]


def tracked_actions(spark: SparkSession) -> DataFrame:
    rows = [(i, "track", f"{uid:06d}") for i, uid in enumerate(TRACKED_SAMPLE)]
    return spark.createDataFrame(rows, "seq long, action string, icao24 string")


def track_log(events: DataFrame) -> DataFrame:
    """A user's actions from `events`: clicks track, errors untrack, the rest only look."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "click", F.lit("track")).when(F.col("event_type") == "error", F.lit("untrack"))
        .otherwise(F.lit("look")).alias("action"),
        icao_of(F.col("user_id")).alias("icao24"),
    )
