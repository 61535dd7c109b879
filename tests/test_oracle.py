from __future__ import annotations

import pytest

import __spark_entry__ as driver
from oracle import connect, differences
from tripmill.plans import oracle as oracle_sql, registry

# What the driver registers beyond these is tested where it is written.
QUERIES, SQL = registry.QUERIES, oracle_sql.ORACLE


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark, sf_dir):
    assert driver.entry(spark).columns == ["year_month", "service_group", "total_trips", "share_pct"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, database, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(found, database.execute(SQL[name]).df()) == []
    assert len(found) > 0
