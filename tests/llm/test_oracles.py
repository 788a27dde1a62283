import pytest

from flowloom.llm.registry import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), ORACLES[name], small)
