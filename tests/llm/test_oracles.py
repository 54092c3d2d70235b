import pytest

from graphloom.llm import queries
from tests.compare import assert_same, connection
from tests.conftest import TINY


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, TINY), connection(TINY), queries.ORACLES[name])
