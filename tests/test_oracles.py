"""Every named query against its SQL at the smallest scale."""

import pytest
from oracle_check import check, duck, plan

import __spark_entry__ as entry
from hitgauge.plans.catalog import QUERIES
from hitgauge.plans.catalog_sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    def no_cross_join(df):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text

    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    problem, _, _, rows = check(spark, con, SF, query, sql, no_cross_join)
    assert problem is None
    # half of the 87 turns is no more than the 50 queries wanted, so no run is drawn here
    assert rows > 0 or name == "bootstrap_sizes"


def test_every_sql_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 100
