"""Every query with an SQL twin gives the same rows at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from helpers import SF
from tools.check_oracle import compare, connect

ORACLES = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    found = df.collect()
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert compare(found, df.columns, cursor.fetchall(), columns) == ""


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["series_id", "obs_date", "p_up_logreg", "decision", "confidence"]
    assert df.count() == 6


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(driver.queries())
