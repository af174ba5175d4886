import math
import random
from collections import defaultdict

import cases
import pytest

from motifel.llm import mixing


def brute_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Filling by small steps: what is left goes to the sources that are not full, by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    level_low, level_high, total = 0.0, 1e18, share * sum(sizes.values())
    for _ in range(300):
        mid = (level_low + level_high) / 2
        if sum(min(cap * sizes[s], w[s] * mid) for s in order) < total:
            level_low = mid
        else:
            level_high = mid
    return {s: min(cap * sizes[s], w[s] * level_high) for s in order}


@pytest.mark.parametrize("seed", range(8))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = {f"s{i}" if i else None: rng.choice([0, 1, 10, rng.randint(1, 10**6)]) for i in range(rng.randint(1, 25))}
    got = dict(zip(sizes, mixing.targets(list(sizes.items())), strict=True))
    want = brute_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-6, abs_tol=1e-6) for s in sizes)


def check(rows, got, near=0.01, slack=3):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = brute_targets(dict(sizes))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len((r[1] or "").encode().split())) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-6, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near * t + slack, (s, taken[s], t)


def test_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    got = mixing.mix(docs).collect()
    rows = [(r.doc_id, r.text, None, r.source) for r in docs.collect()]
    check(rows, got, near=0.03, slack=5)  # ten documents a source
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_hot_source_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, cases.prose(rng, rng.randint(1, 80)), None, "hot" if i % 3 else f"s{i % 7}", None, None, None, None) for i in range(3000)]
    check(rows, mixing.mix(cases.table(spark, rows), block_rows=200).collect(), near=0.005, slack=8)


def test_rates_are_tilted_by_size(spark):
    """A source that gives more than it has takes its long documents twice first; one that gives less leaves them out first."""
    rng = random.Random(5)
    rows = [(i, cases.prose(rng, rng.randint(1, 300)), None, s, None, None, None, None) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    got = [r for r in mixing.mix(cases.table(spark, rows)).collect() if r.source == "c"]
    assert got[0].target < got[0].source_size
    mean = lambda k: sum(r.size for r in got if r.copies == k) / max(1, sum(r.copies == k for r in got))
    assert mean(0) > mean(1)


def test_hard_cases(spark):
    rows = cases.hard_rows()
    got = mixing.mix(cases.table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(cases.table(spark, [])).collect() == []
    only = [(1, None, None, None, None, None, None, None), (2, "", None, "a", None, None, None, None)]
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in mixing.mix(cases.table(spark, only)).collect())


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(cases.table(spark, cases.hard_rows()))


def test_rates_against_an_independent_solution(spark):
    """lambda by halving an interval, for each source alone; and no other rates with those sums are closer to one."""
    rng, state, rows, want = random.Random(9), [], [], {}
    for sid in range(6):
        sizes = [rng.choice([1, 3, 40, 200, 1500]) + sid for _ in range(60)]
        mean, target = sum(sizes) / 60, sum(sizes) * rng.uniform(0.2, 1.9)
        state.append({"sid": sid, "total": sum(sizes), "mean": mean, "target": target, "smallest": min(sizes)})
        rows += [(sid, n, sizes.count(n)) for n in set(sizes)]
        low, high = -1e4, 1e4
        rate = lambda lam, n: min(2.0, math.exp(min(1.0, lam * n / mean)))  # noqa: B023, E731
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(rate(mid, n) * n for n in sizes) < target else (low, mid)
        want[sid] = high
    got = mixing.solve(spark.createDataFrame(rows, "sid int, size long, n long"), state, 2.0)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-4, abs_tol=1e-5) for s in want)
    with pytest.raises(RuntimeError, match="did not reach"):
        mixing.solve(spark.createDataFrame(rows, "sid int, size long, n long"), state, 2.0, rounds=1)
