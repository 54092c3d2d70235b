import pytest

from graphloom.plans import registry

from .compare import assert_same, connection
from .conftest import TINY


@pytest.fixture(scope="module")
def con():
    return connection(TINY)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert_same(registry.queries()[name](spark, TINY), con, registry.oracles()[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracles())
