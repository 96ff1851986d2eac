"""Queries with SQL give its rows on the smallest tables."""

import duckdb
import pytest

from touchline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    wanted = con.sql(SQL[name])
    columns = sorted(wanted.columns)
    found = QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    rows = [tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in found.collect()]
    at = [wanted.columns.index(c) for c in columns]
    expected = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in wanted.fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)
