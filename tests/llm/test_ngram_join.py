import random
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from pyspark.sql import functions as F

from motifel.llm import components as cc
from motifel.llm import ngram_join as nj

LOWEST = -(1 << 63)


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, num=75, den=100):
    """Every pair that shares a shingle, counted; rows are nodes, ids the labels."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
        for x in s:
            at[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 62), LOWEST if d is None else d)
    return cases.norm((d, len(sets[i]), None if least[top(i)] == LOWEST else least[top(i)]) for i, (d, _) in enumerate(rows))


def mutated(rng, words, share):
    return [rng.choice(cases.WORDS) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def corpus(seed, groups=25, members=6, hot=60):
    rng = random.Random(seed)
    fresh = lambda n: [rng.choice(cases.WORDS) + str(rng.randint(0, 9999)) for _ in range(n)]
    passage, out = fresh(60), []
    for _ in range(groups):
        base = fresh(rng.choice([5, 9, 20, 60, 64, 68, 90, 130, 400]))
        out += [mutated(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.05])) for _ in range(members)]
    out += [fresh(rng.randint(5, 60)) + passage + fresh(rng.randint(5, 60)) for _ in range(hot)]
    base = fresh(120)
    out += [mutated(rng, base, 0.012) for _ in range(hot)]
    step = fresh(100)  # a chain of edits: linked only through each other
    for i in range(12):
        step = step[: 8 * i] + fresh(3) + step[8 * i + 3 :]
        out.append(step)
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,frequent,short,block", [(1, 64, 12, 1024), (2, 4, 2, 16), (3, 4, 2, 7)])
def test_against_brute_force(spark, monkeypatch, seed, frequent, short, block):
    """Small limits send the lists of a small table through every path."""
    for k, v in {"FREQUENT": frequent, "FREQUENT_HERE": 2, "SHORT_LIST": short, "BLOCK": block, "BUCKET_RECORDS": 2000}.items():
        monkeypatch.setattr(nj, k, v)
    rows = corpus(seed)
    got = nj.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert cases.norm(got) == brute(rows)


def test_sets_whose_numbers_meet(spark):
    """With 5 bits nearly every number is shared by several sets: they get numbers of their own."""
    rows = corpus(4, groups=12, hot=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cases.norm(nj.ngram_groups(docs, name_bits=5).collect()) == brute(rows)


def test_hard_cases(spark):
    rows = cases.hard_rows()
    got = nj.ngram_groups(cases.table(spark, rows)).collect()
    assert cases.norm(got) == brute([(r[0], r[1]) for r in rows])
    assert nj.ngram_groups(cases.table(spark, [])).collect() == []
    assert [tuple(r) for r in nj.ngram_groups(cases.table(spark, [(5, None, *[None] * 6)])).collect()] == [(5, 0, 5)]


def test_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text")
    assert cases.norm(nj.ngram_groups(docs).collect()) == brute([tuple(r) for r in docs.collect()])


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for _ in range(200):
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in rng.integers(0, 300, 3))
        x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
        if len(x) and len(y):
            two = nj.folded([nj.dense_sketch(x), nj.dense_sketch(y)])
            assert np.bitwise_count(two[0] ^ two[1]).sum() <= len(np.setxor1d(x, y))


def test_linked_sets_meet_in_a_list():
    rng, rule, level = np.random.default_rng(6), nj.Rule(75, 100), np.zeros(nj.LEVELS, np.uint8)
    level[rng.integers(0, nj.LEVELS, nj.LEVELS // 2)] = 9
    tried = 0
    for _ in range(600):
        n = int(rng.choice([1, 2, 3, 5, 8, 20, 50, 63, 64, 85, 86, 127, 128, 300, 700]))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        cut = int(n * 0.25 * rng.random())
        x, y = np.unique(base), np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, int(n * 0.3 * rng.random())).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and rule.linked(both, len(x), len(y)):
            tried += 1
            assert len(np.intersect1d(nj.listed(x, level, rule), nj.listed(y, level, rule)))
    assert tried > 200


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    links += [(5000, i) for i in range(5001, 7100)] + [(i, 5000) for i in range(5001, 5200)]  # a vertex with most of the links
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = [tuple(r) for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted((v, top(v)) for v in {v for a, b in links if a != b for v in (a, b)})
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert cc.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_of_a_shuffled_chain(spark, seed):
    """Chains of revisions whose ids are in no order: rounds stay logarithmic."""
    ids = list(range(4096))
    random.Random(seed).shuffle(ids)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:], strict=False)], "a long, b long")
    maps = cc.contract(links)
    assert len(maps) <= 2 * 12
    left = [m.count() for m in maps]
    assert left[0] == 4096 and all(b <= 0.75 * a + 2 for a, b in zip(left, left[1:], strict=False))


def test_a_star_and_a_clique_take_one_round(spark):
    links = [(i, 0) for i in range(1, 3000)] + [(i, j) for i in range(5000, 5030) for j in range(5000, i)]
    random.Random(1).shuffle(links)
    assert len(cc.contract(spark.createDataFrame(links, "a long, b long"))) == 1


def test_hot_keys_are_few(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("v"))
    assert [r.k for r in cc.hot_keys(rows, "v", 5000).collect()] == [7]
    table = rows.select(F.col("v").alias("k"), (F.col("v") * 2).alias("value")).distinct()
    found = cc.hot_lookup(rows, F.col("v"), 5000, table, cc.hot_keys(rows, "v", 5000), "x")
    assert found.where("x = 2 * v").count() == 5000 == found.count()
    found = cc.hot_lookup(rows, F.col("v"), 5000, table.where("k <> 7"), cc.hot_keys(rows, "v", 5000), "x")
    assert found.where("x is null").count() == 3000 and found.count() == 5000
