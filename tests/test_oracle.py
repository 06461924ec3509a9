"""Every registered query against its SQL on the smallest data."""

import compare
import pytest

import __spark_entry__ as entry
from ferryline.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem, _ = compare.difference(spark, con, name, SF_DIR)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries())
