"""Every query of the subpackage runs; those with SQL give its rows."""

import duckdb
import pytest

from flowsieve.llm.queries import QUERIES
from flowsieve.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def in_order(columns, rows):
    places = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(row[i]) for i in places) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    database = duckdb.connect()
    for t in TABLES:
        database.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    result = database.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, [tuple(r) for r in df.collect()]) == in_order(columns, result.fetchall())
