"""Every registered flow query against DuckDB on the same tables."""

import compare
import pytest

from flowspark.plans import queries


@pytest.fixture(scope="module")
def duck(sf):
    return compare.tables(sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLES:
        compare.assert_same(df, duck, queries.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_approximate_talkers_are_near(spark, sf):
    exact = {r.proto: r.talkers for r in queries.distinct_talkers(spark, sf).collect()}
    for r in queries.approx_talkers(spark, sf).collect():
        assert abs(r.approx - exact[r.proto]) <= 0.1 * exact[r.proto] + 1 and abs(r.hll - exact[r.proto]) <= 0.1 * exact[r.proto] + 1
