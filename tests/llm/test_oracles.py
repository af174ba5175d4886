"""Queries that have SQL against it, over whole tables."""

import duckdb
import pytest

from motifel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, data_dir, name):
    df = queries.QUERIES[name](spark, data_dir)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
