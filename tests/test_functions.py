import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.functions import dna, hashing

MASK = (1 << 64) - 1
NUMBERS = [0, 1, 2, 34, 42, 1 << 31, 1 << 32, (1 << 32) - 1, 1 << 62, (1 << 63) - 1, 1 << 63, MASK, 0x0123456789ABCDEF]


def pure_murmur(key, seed=42):
    def rotl(x, r):
        return ((x << r) | (x >> (64 - r))) & MASK

    def mixed(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = ((x ^ (x >> 33)) * c) & MASK
        return x ^ (x >> 33)

    k = rotl(key * 0x87C37B91114253D5 & MASK, 31) * 0x4CF5AD432745937F & MASK
    h2 = seed ^ 8
    h1 = ((seed ^ k ^ 8) + h2) & MASK
    h2 = (h2 + h1) & MASK
    return (mixed(h1) + mixed(h2)) & MASK


def pure_wang(key, n):
    m = (1 << n) - 1
    key = (~key + (key << 21)) & m
    key ^= key >> 24
    key = key * 265 & m
    key ^= key >> 14
    key = key * 21 & m
    key ^= key >> 28
    return (key + (key << 31)) & m


def longs(spark, values, *more):
    return spark.createDataFrame([(b.signed(v), *m) for v, *m in zip(values, *more, strict=True)], "x long" + "".join(f", y{i} long" for i in range(len(more))))


def test_known_vectors(spark):
    one = spark.range(1)
    row = one.select(
        dna.encode(F.lit("ACTG"), 4), dna.encode(dna.revcomp(F.lit("ACTG")), 4), dna.canonical(dna.encode(F.lit("ACTG"), 4), dna.encode(dna.revcomp(F.lit("ACTG")), 4)), dna.decode(F.lit(27).cast("long"), 4)
    ).first()
    assert tuple(row) == (27, 78, 27, "ACTG")
    assert [f"{x:016X}" for x in hashing.murmur_numpy(np.array([0, 1], np.uint64)).tolist()] == ["434B9AFE2C3E9543", "D3FE46E112F04C44"]
    assert (b.SparseLayout(100).width, b.SparseLayout(100).words, b.SparseLayout(100).threshold) == (8, 2, 7)
    assert (b.SparseLayout(513).width, b.SparseLayout(513).words, b.SparseLayout(513).threshold) == (16, 9, 31)
    packed = one.select(b.words_hex(b.sparse_pack(F.array(F.lit(0), F.lit(5), F.lit(99)), b.SparseLayout(100)))).first()[0]
    assert packed == "0300056300000000"


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unsigned_arithmetic(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rng = random.Random(1)
        xs = NUMBERS + [rng.getrandbits(64) for _ in range(100)]
        for f in (1, 5, 265, 0xFF51AFD7ED558CCD, MASK):
            got = [r[0] & MASK for r in longs(spark, xs).select(b.mul64(F.col("x"), f)).collect()]
            assert got == [x * f & MASK for x in xs]
        ys = xs[::-1]
        rows = longs(spark, xs, [b.signed(y) for y in ys])
        got = rows.select(b.add64(F.col("x"), F.col("y0")), b.rotl(F.col("x"), 13), b.byte_swapped(F.col("x")), b.low32(F.col("x")), b.high32(F.col("x"))).collect()
        for r, x, y in zip(got, xs, ys, strict=True):
            assert [v & MASK for v in r] == [(x + y) & MASK, ((x << 13) | (x >> 51)) & MASK, int.from_bytes(x.to_bytes(8, "little"), "big"), x & 0xFFFFFFFF, x >> 32]
        assert [r[0] & MASK for r in longs(spark, xs).orderBy(b.unsigned_key(F.col("x"))).collect()] == sorted(xs)
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_murmur_three_ways(spark):
    rng = random.Random(2)
    keys = NUMBERS + [rng.getrandbits(64) for _ in range(200)]
    want = [pure_murmur(k) for k in keys]
    assert hashing.murmur_numpy(np.array(keys, np.uint64)).tolist() == want
    assert [r["h"] & MASK for r in hashing.murmur(longs(spark, keys), "x", "h").collect()] == want


@pytest.mark.parametrize("n", [4, 20, 30, 38, 62])
def test_wang_is_one_to_one(spark, n):
    rng = random.Random(n)
    keys = list(range(1 << n)) if n == 4 else [0, 1, (1 << n) - 1, *(rng.getrandbits(n) for _ in range(200))]
    rows = hashing.wang_inverse(hashing.wang(longs(spark, keys), "x", "h", n), "h", "back", n).collect()
    assert [r["h"] for r in rows] == [pure_wang(k, n) for k in keys] and [r["back"] for r in rows] == keys


@pytest.mark.parametrize("k", [1, 4, 10, 15, 16, 17, 31, 32])
def test_encode_and_decode(spark, k):
    rng = random.Random(k)
    mers = ["A" * k, "G" * k, *("".join(rng.choice("ACTG") for _ in range(k)) for _ in range(50))]
    rows = spark.createDataFrame([(m,) for m in mers], "m string").select("m", dna.encode(F.col("m"), k).alias("x")).withColumn("back", dna.decode(F.col("x"), k)).collect()
    assert all(r.back == r.m for r in rows)
    assert [r.x & MASK for r in rows] == [reduce(lambda a, c: a * 4 + "ACTG".index(c), m, 0) for m in mers]


def test_sizes_are_checked():
    for k in (0, 33):
        with pytest.raises(ValueError):
            dna.encode(F.lit("A"), k)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 127, 128, 129, 256, 257, 513])
def test_bitmaps_lists_and_packing(spark, n):
    rng = random.Random(n)
    lists = [[], [0], [n - 1], list(range(n)), *(sorted(rng.sample(range(n), rng.randint(0, n))) for _ in range(10))]
    layout = b.SparseLayout(n)
    df = spark.createDataFrame([(x,) for x in lists], "c array<int>").withColumn("w", b.from_list(F.col("c"), n)).withColumn("p", b.sparse_pack(F.col("c"), layout))
    fits = [x for x in lists if len(x) < 1 << layout.width]  # the count is a field too
    for r in df.select("c", "w", "p", b.to_list(F.col("w"), n).alias("back"), b.popcount(F.col("w")).alias("pop"), b.sparse_unpack(F.col("p"), layout).alias("unpacked")).collect():
        words = [0] * b.words_needed(n)
        for c in r.c:
            words[c // 64] |= 1 << (c % 64)
        assert [w & MASK for w in r.w] == words and r.back == r.c and r["pop"] == len(r.c)
        if r.c in fits:
            assert r.unpacked == r.c and len(r.p) == (len(r.c) + layout.per_word) // layout.per_word
