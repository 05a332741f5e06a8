"""Every registered query against its oracle, on the smallest tables."""

import pytest

import compare
from reachgrid.catalog import load

FOLDER = f"{compare.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(FOLDER)


@pytest.mark.parametrize("name", list(load()[0]))
def test_query(spark, con, name):
    assert compare.compare(spark, con, name, FOLDER) is None


def test_every_query_has_an_oracle():
    queries, oracle = load()
    assert set(oracle) <= set(queries)
    assert set(queries) == set(oracle)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == ["departure_time", "mode", "purpose", "cell_id", "score", "score_normalized"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(load()[0]) <= set(driver.queries())
