"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as entry
from bindings.queries import QUERIES
from tests.compare import connect, differences

STATEMENTS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(STATEMENTS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf_dir, con, name):
    diff = differences(entry.queries()[name](spark, sf_dir), con, STATEMENTS[name])
    assert diff is None, diff


def test_entry(spark):
    assert entry.entry(spark).count() > 0
