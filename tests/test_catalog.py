"""Every registered query against its SQL, run by DuckDB on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = driver.queries(), driver.oracle_sql()
# These have tests of their own.
LLM = set(driver.LLM_QUERIES)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def in_order(columns, rows):
    places = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(row[i]) for i in places) for row in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(SQL) - LLM))
def test_matches_sql(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    result = database.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, [tuple(r) for r in df.collect()]) == in_order(
        columns, result.fetchall()
    )


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LLM))
def test_runs_without_sql(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows
    values = [v for row in rows for v in row.asDict().values() if isinstance(v, float)]
    assert all(math.isfinite(v) for v in values)
    shares = ("confidence", "ks", "auc", "stage1_f1", "final_f1", "queue_precision")
    assert all(0 <= row[c] <= 1 for row in rows for c in row.asDict() if c in shares)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
