"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_registered(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    got = rows_of(result.columns, [tuple(row) for row in result.collect()])
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [item[0] for item in cursor.description]
        assert sorted(columns) == sorted(result.columns)
        assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 200
