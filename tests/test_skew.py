"""A key holding a third of all rows must not be processed by one task."""

import datetime as dt

from pyspark.sql import functions as F

from contrail.operators.latest import latest_per_key
from contrail.operators.ordered import with_previous, with_running_sum
from contrail.operators.trails import hourly
from tests._compare import rows_of, spark_rows

T0 = dt.datetime(2024, 1, 1)


def _skewed(spark, n=30_000):
    # key "hot" gets every third row; 200 other keys share the rest; 10 days
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string")))
        .alias("icao24"),
        (F.lit(T0) + F.make_dt_interval(secs=(F.col("id") * 29).cast("int"))).cast("timestamp_ntz").alias("time"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 == 0, F.lit("GROUND")).otherwise(F.lit("CRUISE")).alias("flight_phase"),
        (F.col("id") % 13).cast("double").alias("v"),
    )
    return df


def _max_share_of_hot(df, used: str) -> float:
    """Largest share of the hot key's rows computed by one task (``used``
    is an output of the operator, so the operator stays in the plan).
    AQE partition coalescing is off while measuring: on this small input it
    would merge everything into one task regardless of the plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return _share(df, used)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _share(df, used: str) -> float:
    hot = df.filter(F.col("icao24") == "hot").select(F.spark_partition_id().alias("p"), F.col(used))
    per_task = hot.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count(used).alias("u"))
    stats = per_task.agg(F.max("n"), F.sum("n"), F.sum("u")).first()  # keep `used` live
    return stats[0] / stats[1]


def test_previous_row_splits_a_hot_key(spark):
    df = _skewed(spark)
    split = with_previous(df, ["icao24"], ["time", "event_id"], ["flight_phase"], bucket=hourly())
    plain = with_previous(df, ["icao24"], ["time", "event_id"], ["flight_phase"])
    assert _max_share_of_hot(plain, "prev_flight_phase") == 1.0   # one window partition = one task
    assert _max_share_of_hot(split, "prev_flight_phase") < 0.25   # spread over (key, hour) partitions
    assert spark_rows(split) == spark_rows(plain)


def test_running_sum_splits_a_hot_key(spark):
    df = _skewed(spark)
    split = with_running_sum(df, ["icao24"], ["time", "event_id"], "v", "s", bucket=hourly())
    plain = with_running_sum(df, ["icao24"], ["time", "event_id"], "v", "s")
    assert _max_share_of_hot(plain, "s") == 1.0
    assert _max_share_of_hot(split, "s") < 0.25
    assert spark_rows(split) == spark_rows(plain)


def test_latest_per_key_limits_before_shuffle(spark):
    df = _skewed(spark).repartition(8)
    out = latest_per_key(df, "icao24", ("time", "event_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    limits = [l for l in plan.splitlines() if "WindowGroupLimit" in l]
    assert any("Partial" in l for l in limits)
    assert out.filter(F.col("icao24") == "hot").first()["event_id"] == 29_997


def test_deadband_split_by_chunk_equals_single_pass(spark, monkeypatch):
    """P17 split by (aircraft, time chunk) is exact: a hot key, parked
    stretches (whole chunks inside the reference box) and slow motion whose
    kept points fall out of step with a chunk's own first point."""
    from contrail.operators import geo as G

    n = 6_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 20).cast("string")))
        .alias("icao24"),
        (F.lit(T0) + F.make_dt_interval(secs=(F.col("id") * 7).cast("int"))).cast("timestamp_ntz").alias("time"),
        F.col("id").alias("event_id"),
        F.when((F.col("id") / 500).cast("int") % 4 == 1, F.lit(10.0) + (F.col("id") % 3) * 0.0001)
        .otherwise(F.lit(10.0) + F.col("id") * 0.00013).alias("latitude"),
        (F.lit(20.0) + F.sin(F.col("id") / 50.0) * 0.0004).alias("longitude"),
    )
    want, last = [], {}
    for r in df.orderBy("icao24", "time", "event_id").collect():
        ref = last.get(r.icao24)
        if ref is None or abs(r.latitude - ref[0]) >= 0.001 or abs(r.longitude - ref[1]) >= 0.001:
            last[r.icao24] = (r.latitude, r.longitude)
            want.append(tuple(r))
    want = rows_of(df.columns, want)
    assert len(want) < 0.67 * n  # the filter is exercised
    for points in (256, 16, 1):
        assert spark_rows(G.deadband(df, 0.001, points=points)) == want
    assert "Python" not in G.deadband(df, 0.001, points=2000)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it lands its chunks
    monkeypatch.setattr(G, "ROUNDS", 50)
    spread = G.deadband(df.filter("latitude > 10.2"), 0.001, points=64)
    assert _max_share_of_hot(spread, "latitude") < 0.5
