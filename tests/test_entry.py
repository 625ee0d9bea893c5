"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, engine, name):
    result = QUERIES[name](spark, FOLDER)
    rows = result.collect()
    assert rows
    if name in ORACLE:
        want = engine.sql(ORACLE[name])
        assert _sorted(rows, result.columns) == _sorted(want.fetchall(), want.columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES)
