"""Queries over sets of very many colors, each row with few: results by SQL, and nothing between steps as long as all words."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from motifel.functions import bits
from motifel.operators import colors, order
from motifel.plans import catalog
from motifel.sources import rawmini, storage
from motifel.sources.scratch import shared_path


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with lineitem: 60 keys, 300,000 colors; some keys share their colors."""
    rng, at = random.Random(9), tmp_path_factory.mktemp("many")
    rows = []
    for k in range(60):
        ids = [0, 63, 64, 299_999] if k % 7 == 0 else [rng.randrange(300_000) for _ in range(rng.randint(1, 9))]
        rows += [(k, k * 31, c, i % 7 + 1) for i, c in enumerate(ids)]
    rows.append((99, 5, 299_999, 1))
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").repartition(4).write.parquet(str(at / "lineitem.parquet"))
    return str(at)


def tables(spark) -> set[str]:
    return set(glob.glob(f"{os.path.dirname(shared_path(spark, 'x'))}/ordinal-*"))


def run(spark, many, name):
    """Rows of the query, equal to its SQL, and the columns of the tables that ordinal wrote."""
    before = tables(spark)
    df = catalog.QUERIES[name](spark, many)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{many}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    return df, [set(spark.read.parquet(t).columns) for t in tables(spark) - before]


def test_raw_dump_numbers_rows_before_it_writes_them_out(spark, many):
    _, written = run(spark, many, "raw_dump")
    assert written == [{"minimizer", "nonzero", "__at"}]


def test_check_sorted_keeps_rows_small(spark, many):
    df, written = run(spark, many, "check_sorted")
    assert written == [{"minimizer", "nonzero", "__at"}] and tuple(df.first()) == (len({r.l_partkey for r in spark.read.parquet(f"{many}/lineitem.parquet").collect()}), 0)


def test_keys_of_many_words_are_short_and_sort_alike(spark):
    rng = random.Random(2)
    sets = {k: sorted(rng.sample([0, 1, 7, 8, 63, 64, 127, 128, 70_000, 299_999], rng.randint(0, 4))) for k in range(300)}
    whole = {k: b"".join((sum(1 << (c % 64) for c in v if c // 64 == i)).to_bytes(8, "little") for i in range(4688)) for k, v in sets.items()}
    rows = colors.nonzero_rows(spark.createDataFrame([(k, c) for k, v in sets.items() for c in v or [None]], "minimizer long, color int"))
    keyed = {r.minimizer: bytes(r.key) for r in rows.select("minimizer", order.dense_key_of(F.col("nonzero"), F.col("minimizer")).alias("key")).collect()}
    assert sorted(sets, key=keyed.get) == sorted(sets, key=lambda k: (whole[k], k)) and max(map(len, keyed.values())) <= 12 * 4 + 12
    dense = rows.select("minimizer", bits.nonzero_words(F.col("nonzero"), 4688).alias("w"))
    assert {r.minimizer: bytes(r.key) for r in dense.select("minimizer", order.dense_key(F.col("w"), F.col("minimizer")).alias("key")).collect()} == keyed


def test_color_sorter_keeps_rows_small(spark, many):
    _, written = run(spark, many, "color_sorter")
    assert sorted(written, key=len) == [{"minimizer", "nonzero", "__at"}, {"minimizer", "nonzero", "ordinal", "__at"}]


def test_merged_sets_meet_by_few_words(spark, many):
    df, _ = run(spark, many, "merge_final_sparse")
    assert "color_words" not in df._jdf.queryExecution().analyzed().toString()
    run(spark, many, "merge_final_dense")


def test_raw_roundtrip_gives_spark_few_words(spark, many):
    df, _ = run(spark, many, "raw_roundtrip")
    assert "color_words" not in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("n", [1, 64, 130, 5000])
@pytest.mark.parametrize("codec", ["", "lz4"])
def test_files_of_nonzero_words_are_those_of_all_words(spark, tmp_path, n, codec):
    rng = random.Random(n)
    sets = {k * 7 - 70: {rng.choice([0, n - 1, rng.randrange(n)]) for _ in range(rng.randint(0, 3))} for k in range(300)}
    rows = colors.nonzero_rows(spark.createDataFrame([(k, c) for k, v in sets.items() for c in sorted(v) or [None]], "minimizer long, color int")).orderBy("minimizer").coalesce(1)
    rawmini.write_raw_nonzero(rows, str(tmp_path / "some"), n, codec)
    rawmini.write_raw(colors.with_words(rows, n), str(tmp_path / "all"), "color_words", codec)
    name = "part-00000.raw" + (codec and "." + codec)
    plain = [storage.open_in(str(tmp_path / x / name)).read() for x in ("some", "all")]
    assert plain[0] == plain[1] and len(plain[0]) == 300 * 8 * (1 + bits.words_needed(n))
    back = rawmini.read_raw(spark, str(tmp_path / "some"), n, split=1000, nonzero=True)
    assert {r.minimizer: set(r.l) for r in back.select("minimizer", bits.nonzero_list(F.col("nonzero"), n).alias("l")).collect()} == sets
