import pytest

from strataloom.plans.catalog import ORACLES, QUERIES
from tests.compare import duck, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, small, name):
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck(small), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 20
    assert set(e.oracle_sql()) <= set(e.queries())
