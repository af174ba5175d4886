import random

import pytest
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.operators import colors, merge, order, stats

MASK = (1 << 64) - 1


def fixture_set(v):
    """Set v of the generated family: 0 and v in each byte of a word."""
    return sorted({b.signed(0), *(b.signed(v << (8 * i)) for i in range(8))})


def pairs(spark, n):
    return spark.createDataFrame([(x, i) for i in range(n) for x in fixture_set(i % 256 + (i // 256))], "minimizer long, color int")


@pytest.mark.parametrize("n", [1, 2, 4, 16, 63, 64, 65, 66, 128, 129, 256, 257, 1100])
def test_merge_then_extract_gives_each_input_back(spark, n):
    rows = colors.color_words(pairs(spark, n), n).cache()
    for c in {0, 1 % n, n // 2, n - 1}:
        assert sorted(r[0] for r in colors.extract_color(rows, c, n).collect()) == fixture_set(c % 256 + c // 256)
    back = {(r.minimizer, r.color) for r in colors.as_pairs(rows, n).collect()}
    assert back == {(x, i) for i in range(n) for x in fixture_set(i % 256 + i // 256)}
    layout = b.SparseLayout(n)
    dense, sparse = colors.split_dense(rows, layout).count(), colors.split_sparse(rows, layout)
    assert dense + sparse.count() == rows.count()
    assert {(r.minimizer, c) for r in sparse.collect() for c in r.colors} <= back
    rows.unpersist()


def test_a_color_that_is_not_there(spark):
    with pytest.raises(ValueError):
        colors.extract_color(colors.color_words(pairs(spark, 2), 2), 2, 2)


def random_rows(spark, seed, n, keys=60):
    rng = random.Random(seed)
    sets = {b.signed(rng.getrandbits(64)): sorted(rng.sample(range(n), rng.randint(1, n))) for _ in range(keys)}
    p = spark.createDataFrame([(k, c) for k, v in sets.items() for c in v], "minimizer long, color int")
    return sets, colors.color_words(p, n)


@pytest.mark.parametrize("a,c", [(1, 1), (5, 3), (32, 32), (60, 5), (64, 64), (100, 3), (3, 100), (130, 65)])
def test_two_colored_sets(spark, a, c):
    left, lrows = random_rows(spark, 1, a)
    right, rrows = random_rows(spark, 2, c)
    some = dict(list(left.items())[:20])
    shared = spark.createDataFrame([(k, x) for k, v in some.items() for x in sorted({v[0] % c, c - 1})], "minimizer long, color int")
    rrows = rrows.union(colors.color_words(shared, c))
    right = right | {k: sorted({v[0] % c, c - 1}) for k, v in some.items()}
    start = a if a + c <= 64 else 64 * b.words_needed(a)
    n = a + c if a + c <= 64 else 64 * (b.words_needed(a) + b.words_needed(c))
    got = {r.minimizer: r.l for r in merge.merge_two_colored(lrows, rrows, a, c).select("minimizer", b.to_list(F.col("color_words"), n).alias("l")).collect()}
    want = {k: [*left.get(k, []), *(x + start for x in right.get(k, []))] for k in {*left, *right}}
    assert got == want
    dense, sparse, layout = merge.merge_final(lrows, rrows, a, c)
    few = {r.minimizer: r for r in sparse.withColumn("back", b.sparse_unpack(F.col("packed"), layout)).collect()}
    plain = {k: [*left.get(k, []), *(x + a for x in right.get(k, []))] for k in want}
    assert {k: r.back for k, r in few.items()} == ({k: v for k, v in plain.items() if len(v) <= layout.threshold} if a + c > 64 else {})
    assert dense.count() + len(few) == len(want)


def test_plain_merges_and_report(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "minimizer long")
    a, c, e = one(1, 2, -1), one(2, 3), spark.createDataFrame([], "minimizer long")
    assert sorted(r[0] for r in merge.merge_plain(a, c, e).collect()) == [-1, 1, 2, 3]
    assert merge.merge_plain(e, e).count() == 0
    assert tuple(merge.merge_report(a, c).first()) == (5, 1, 4) and tuple(merge.merge_report(e).first()) == (0, 0, 0)
    assert {(r.minimizer, r.w0) for r in colors.color_bitmap(merge.merge_n(a, c)).collect()} == {(1, 1), (2, 3), (3, 2), (-1, 1)}


@pytest.mark.parametrize("n", [5, 64, 130])
def test_orders(spark, n):
    sets, rows = random_rows(spark, n, n, 300)
    words = lambda k: [sum(1 << (c % 64) for c in sets[k] if c // 64 == i) for i in range(b.words_needed(n))]
    dense = sorted(sets, key=lambda k: (b"".join(w.to_bytes(8, "little") for w in words(k)), k & MASK))
    assert [r.minimizer for r in order.sort_dense(rows).collect()] == dense
    numbered = order.ordinal(rows, order.dense_key(F.col("color_words"), F.col("minimizer")))
    assert [r.minimizer for r in sorted(numbered.collect(), key=lambda r: r.idx)] == dense
    sparse = sorted(sets, key=lambda k: (len(sets[k]), sets[k], k & MASK))
    lists = spark.createDataFrame(list(sets.items()), "minimizer long, colors array<int>").repartition(5)
    assert [r.minimizer for r in order.sort_sparse(lists).collect()] == sparse
    assert [r.minimizer for r in order.color_top(lists, 16).collect()] == sparse[:16]
    assert [r.minimizer for r in order.color_top(lists, 16, False).collect()] == sparse[::-1][:16]
    by_number = {k: i for i, k in enumerate(sorted(sets, key=lambda k: k & MASK))}
    want = [by_number[k] for k in sorted(sets, key=lambda k: (words(k), -by_number[k]))]
    assert [r.ordinal for r in sorted(order.color_sorter(rows).collect(), key=lambda r: r.idx)] == want


def test_checks(spark):
    one = lambda v: order.ordinal(spark.createDataFrame([(x,) for x in v], "minimizer long"), b.hex16(F.col("minimizer")))
    a, c = one(range(100)), one([x + (x >= 50) for x in range(120)])
    assert tuple(order.check_sorted(a, F.col("minimizer"), "idx").first()) == (100, 0)
    assert tuple(order.check_sorted(a, F.col("minimizer") % 10, "idx").first()) == (100, 9)
    got = sorted(order.raw_compare(a, c).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(34, 66)) and [r.same for r in got] == [i < 50 for i in range(34, 66)]
    assert order.raw_compare(a, a).count() == 0
    empty = spark.createDataFrame([], "minimizer long")
    assert order.ordinal(empty, b.hex16(F.col("minimizer"))).count() == 0


def test_checks_across_partitions(spark):
    """The last key of a partition against the first of the next: 3, 2 | 1, 0 falls three times."""
    rows = spark.createDataFrame([(3,), (2,), (1,), (0,)], "minimizer long").coalesce(1)
    two = spark.range(0, 4, 1, 2).select((3 - F.col("id")).alias("minimizer"))
    assert two.rdd.getNumPartitions() == 2
    for df in (rows, two):
        assert tuple(order.check_sorted(df, F.col("minimizer")).first()) == (4, 3)
    gaps = spark.range(0, 100, 1, 10).where("id < 20 or id >= 70").select(F.when(F.col("id") == 70, 5).otherwise(F.col("id")).alias("minimizer"))
    assert tuple(order.check_sorted(gaps, F.col("minimizer")).first()) == (50, 1)
    assert tuple(order.check_sorted(rows.where("minimizer > 9"), F.col("minimizer")).first()) == (0, 0)


def test_ordinals_of_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("minimizer"))
    got = order.ordinal(rows, b.hex16(F.col("minimizer")))
    assert got.where("idx <> minimizer").count() == 0 and got.count() == 5000


def test_reports(spark):
    sets, rows = random_rows(spark, 3, 70, 200)
    h = sorted(stats.color_histogram(rows).collect(), key=lambda r: r.n_colors)
    assert sum(r.occurrences for r in h) == len(sets) and abs(h[-1].cumulative - 100) < 1e-9
    s = stats.color_summary(rows, 70).first()
    assert (s.n_keys, s.n_words, s.n_pairs) == (len(sets), 3 * len(sets), sum(map(len, sets.values())))


def test_extensions(spark):
    sets, rows = random_rows(spark, 4, 70, 200)
    has = lambda *c: {k for k, v in sets.items() if set(c) <= set(v)}
    assert {r[0] for r in colors.ext_intersect(rows, [2, 66], 70).collect()} == has(2, 66)
    assert {r[0] for r in colors.ext_except(rows, [2], [66, 3], 70).collect()} == has(2) - has(66) - has(3)
    p = colors.as_pairs(rows, 70)
    for r in colors.ext_jaccard(p, 70).where("a = 2 and b = 66").collect():
        assert r.n_both == len(has(2, 66)) and abs(r.jaccard - len(has(2, 66)) / len(has(2) | has(66))) < 1e-12


def test_dimension_keeps_empty_sets(spark):
    names = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "file string")
    assert {r.file: r.color_id for r in colors.color_dimension(names).collect()} == {"a": 0, "b": 1, "c": 2}


def test_more_than_64_colors(spark, tmp_path):
    """Sources 0 and 64 have bits of their own; the one-word form refuses them."""
    from motifel.plans import catalog

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(70)]
    spark.createDataFrame([(i, t, "en", f"s{i:02}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.color_index_rows(spark, str(tmp_path)).collect()
    want = {r.minimizer & (1 << 64) - 1: sum(1 << c for c in r.l) for r in catalog._source_index(spark, str(tmp_path)).pairs.groupBy("minimizer").agg(F.collect_set("color").alias("l")).collect()}
    assert {int(r.minimizer, 16): int(r.w0, 16) | int(r.w1, 16) << 64 for r in rows} == want and any(v >> 64 for v in want.values())
    with pytest.raises(Exception, match="color_words"):
        colors.color_bitmap(spark.createDataFrame([(1, 64)], "minimizer long, color int")).collect()


@pytest.mark.parametrize("n", [5, 64, 130, 1100, 5000])
def test_nonzero_words_are_the_same_rows(spark, n):
    rng = random.Random(n)
    sets = {b.signed(rng.getrandbits(64)): sorted({*rng.sample(range(n), rng.randint(1, 4)), rng.choice([0, n - 1])}) for _ in range(40)}
    p = spark.createDataFrame([(k, c) for k, v in sets.items() for c in v] * 2 + [(5, None)], "minimizer long, color int").repartition(3)
    words, some = b.words_needed(n), F.col("nonzero")
    made = colors.nonzero_rows(p)
    shown = made.select("minimizer", "nonzero", b.nonzero_words(some, words).alias("w"), b.nonzero_hex(some, words).alias("x"), b.nonzero_list(some, n).alias("l"), b.nonzero_popcount(some).alias("n"))
    for r in shown.withColumn("back", b.nonzero(F.col("w"))).withColumn("hex", b.words_hex(F.col("w"))).collect():
        want = sets.get(r.minimizer, [])
        assert r.l == want and r.n == len(want) and r.nonzero == r.back and r.x == r.hex and len(r.w) == words
        assert [x % (1 << 64) for x in r.w] == [sum(1 << (c % 64) for c in want if c // 64 == i) for i in range(words)]
    assert {(r.minimizer, r.color) for r in colors.as_pairs(made, n).collect()} == {(k, c) for k, v in sets.items() for c in v}
