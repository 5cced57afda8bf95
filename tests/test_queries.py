"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from glossaflow.plans.registry import all_queries
from compare import connect, difference, rows_of_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in all_queries()}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    found = [tuple(r) for r in frame.collect()]
    if name in ORACLES:
        assert difference(frame.columns, found, *rows_of_sql(connection, ORACLES[name])) is None
    else:
        assert found


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
