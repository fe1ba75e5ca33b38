import pytest

from abundex.plans import registry
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    same(registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
