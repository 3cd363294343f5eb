"""Core queries against their SQL at the smallest scale."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle import compare, database  # noqa: E402

from sparktraj.plans import catalogue  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql()[name], DIR) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).columns
    catalogue.queries()[name](spark, DIR).count()
