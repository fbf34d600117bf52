"""Every registered query with a DuckDB counterpart must agree with it; the others must run."""

import pytest
from compare import connect, diff

import __spark_entry__ as entry

RUN, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, sf, duck, name):
    df = RUN[name](spark, sf)
    if name in SQL:
        problem, _ = diff(df, duck, SQL[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.num_queries == 10 and 0 <= row.strict_hit1 <= row.strict_hit3 <= row.strict_hit10 <= 1
