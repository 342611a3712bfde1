import pytest

from meshlark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert same(QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLE_SQL[name]).df()) == ""
