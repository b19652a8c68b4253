"""Operators that SQL can express, beside it."""

import os

import pytest

from check import connect, difference
from riskweave.llm import queries

SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert difference(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None
