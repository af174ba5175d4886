"""Queries against their SQL, as the driver does, and that the library stands without its training-data part."""

import glob
import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from motifel.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{data_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, data_dir, duck, name):
    df = catalog.QUERIES[name](spark, data_dir)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    pick = lambda rows, cols: sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=repr)
    assert pick(rows, df.columns) == pick(want.fetchall(), want.columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_only_the_entry_names_the_training_data_part():
    for p in (ROOT / "motifel").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
