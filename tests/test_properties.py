"""Property tests: the skew-splitting helpers equal their one-window forms."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contrail.operators.latest import latest_per_key, merge_state
from contrail.operators.ordered import with_previous, with_running_sum
from tests._compare import spark_rows

T0 = dt.datetime(2024, 1, 1)

rows_st = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 200), st.sampled_from(["GROUND", "CRUISE", None]),
              st.floats(0, 10, allow_nan=False)),
    min_size=1, max_size=40, unique_by=lambda r: r[1])

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    data = [(k, T0 + dt.timedelta(minutes=m), m, p, v) for k, m, p, v in rows]
    return spark.createDataFrame(data, "k string, t timestamp_ntz, tie long, p string, v double")


@SETTINGS
@given(rows=rows_st)
def test_previous_bucketed_equals_plain(spark, rows):
    df = _df(spark, rows)
    plain = with_previous(df, ["k"], ["t", "tie"], ["p", "v"])
    split = with_previous(df, ["k"], ["t", "tie"], ["p", "v"], bucket=F.date_trunc("hour", "t"))
    assert spark_rows(plain) == spark_rows(split)


@SETTINGS
@given(rows=rows_st)
def test_running_sum_bucketed_equals_plain(spark, rows):
    df = _df(spark, rows)
    plain = with_running_sum(df, ["k"], ["t", "tie"], "v", "s")
    split = with_running_sum(df, ["k"], ["t", "tie"], "v", "s", bucket=F.date_trunc("hour", "t"))
    assert spark_rows(plain.select("k", "tie", F.col("s").cast("decimal(38,12)").alias("s"))) == spark_rows(
        split.select("k", "tie", "s"))


@SETTINGS
@given(rows=rows_st)
def test_latest_is_max_over_key(spark, rows):
    df = _df(spark, rows)
    got = {r.k: r.tie for r in latest_per_key(df, "k", ("t", "tie")).collect()}
    want = {}
    for k, m, _, _ in rows:
        want[k] = max(want.get(k, -1), m)
    assert got == want


@SETTINGS
@given(rows=rows_st, cut=st.integers(0, 200))
def test_merge_is_associative(spark, rows, cut):
    df = _df(spark, rows).withColumnRenamed("tie", "offset")
    state = latest_per_key(df.filter(F.col("offset") < cut // 2), "k", ("offset",))
    a = df.filter((F.col("offset") >= cut // 2) & (F.col("offset") < cut))
    b = df.filter(F.col("offset") >= cut)
    two_steps = merge_state(merge_state(state, a, "k", ("offset",)), b, "k", ("offset",))
    one_step = merge_state(state, a.unionByName(b), "k", ("offset",))
    assert spark_rows(two_steps) == spark_rows(one_step)
