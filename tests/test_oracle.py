"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from helpers import DATA, sort_key
from oracle.sql import ORACLE
from walletscope.plans.registry import QUERIES

TABLES = ("part", "supplier", "lineitem", "orders", "customer", "nation", "region", "events")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT * FROM ({entry.oracle_sql()[name]})")
    position = {column[0]: i for i, column in enumerate(want.description)}
    assert sorted(position) == columns
    expected = [tuple(row[position[c]] for c in columns) for row in want.fetchall()]
    actual = [tuple(row) for row in got.select(*columns).collect()]
    assert sorted(actual, key=sort_key) == sorted(expected, key=sort_key)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
