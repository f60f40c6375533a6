"""Physical plan checks: the plans we want, not just the right rows."""

import pytest

from contrail.plans.registry import queries
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
# streaming jobs: what they return is a table they wrote
PYTHON_OK = {n for n in queries() if n.startswith("stream_")} | {
    "ingest_accounting", "history_append_replay", "history_retention", "history_compacted", "snapshot_ticks"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_uses_partial_window_group_limit(spark):
    p = plan(queries()["trail_points"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_airline_lookup_broadcasts_bounded_dimension(spark):
    p = plan(queries()["airline_lookup"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_aircraft_dimension_broadcast_behind_row_check(spark):
    p = plan(queries()["aircraft_dim_join"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_time_filter_reaches_parquet_scan(spark):
    df = queries()["full_flight_points"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in p.split("PushedFilters:")[1].split("]")[0]


def test_column_pruning_on_scan(spark):
    p = plan(queries()["trail_points"](spark, SF_SMALL))
    assert "props" not in p.split("ReadSchema:")[1].split("\n")[0]


@pytest.mark.parametrize("name", sorted(set(queries()) - PYTHON_OK))
def test_no_python_in_the_hot_path(spark, name):
    p = plan(queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PYTHON_NODES), name


def test_route_pick_limits_before_the_shuffle(spark):
    p = plan(queries()["route_pick"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p
