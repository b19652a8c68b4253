"""Every query beside its SQL counterpart, over whole tables of the smallest scale."""

import os

import pytest

import __spark_entry__ as driver
from check import connect, difference
from riskweave.plans import oracle, queries

SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
