"""Every registered query with a SQL oracle equals DuckDB on the given tables."""

import pytest

from contrail.plans.registry import oracle_sql, queries
from tests._compare import duck, duck_rows, spark_rows
from tests.conftest import SF_SMALL

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    cols, expected = duck_rows(con, ORACLE[name])
    assert sorted(df.columns) == sorted(cols)
    assert spark_rows(df) == expected


def test_every_query_has_a_callable():
    qs = queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 60
