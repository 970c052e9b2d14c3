"""Every registered query against its SQL twin."""

import pytest
from check_oracle import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from txrisk.catalog import QUERIES
from txrisk.oracle import statements

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_names():
    assert set(SQL) <= set(entry.queries())
    # Every query of the library itself has SQL; some of the optional corpus queries cannot.
    assert set(QUERIES) == set(statements())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, con, name):
    assert compare(entry.queries()[name](spark, SMALL), con, SQL[name]) == ""


def test_a_difference_is_seen(spark, con):
    sql = SQL["filter_label"].replace("flag = 1", "flag = 0")
    assert compare(entry.queries()["filter_label"](spark, SMALL), con, sql) != ""


def test_entry(spark):
    assert entry.entry(spark).count() == 150
