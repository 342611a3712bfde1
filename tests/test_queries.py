"""Every query that has SQL agrees with it; every query gives rows."""

import pytest

from meshlark.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert same(got, con.sql(ORACLE_SQL[name]).df()) == ""


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE_SQL


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
