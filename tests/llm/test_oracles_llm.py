import pytest
from oracle import compare

from talweg.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    compare(QUERIES[name](spark, small), ORACLES[name], small)
