"""Training-data queries against their SQL at the smallest scale, and every query once over its whole tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, database  # noqa: E402

from sparktraj.llm import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    q, sql = queries.queries()[name], queries.oracle_sql().get(name)
    if sql:
        assert compare(spark, con, name, q, sql, DIR) == ""
    else:
        assert q(spark, DIR).count() >= 0
