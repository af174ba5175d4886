import hashlib
import os
import re
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from motifel.llm import common
from motifel.llm import exact_dedup as exact
from motifel.llm.exact_dedup import LEAST_RUNS, exact_dedup, runs_of, schedule
from motifel.llm.line_dedup import line_dedup

LOWEST = -(1 << 63)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("parts,ways,runs", [(1, 8, None), (7, 2, 7), (12, 4, 9), (12, 8, 12)])
def test_exact_dedup_against_brute_force(spark, keep, parts, ways, runs):
    rows = cases.hard_rows() * 2 + [(1000 + i, "Same Text" if i % 3 else f"text {i % 7}", None, None, None, None, None, None) for i in range(300)]
    got = exact_dedup(cases.table(spark, rows, parts), keep, ways, runs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(LOWEST if r[0] is None else r[0])
    best = max if keep == "largest" else min
    want = []
    for t, ids in groups.items():
        k = best(ids)
        want += [(None if i == LOWEST else i, None if k == LOWEST else k, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert cases.norm((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == cases.norm(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("ways", [2, 4, 8])
def test_rounds_of_the_tree(ways):
    """Slots are fewer than twice the runs, and no round lets more than ``ways`` runs meet."""
    for runs in [1, 2, 3, 4, 5, 8, 9, 64, 65, 512, 513, 4096, 4097, 32768, 32769, 262144, 262145]:
        plan = schedule(runs, ways)
        assert max(runs, 2) <= 1 << sum(plan) < 2 * max(runs, 2)
        assert max(plan) <= ways.bit_length() - 1 and max(plan) - min(plan) <= 1
        assert len(plan) >= 2 or runs < 3


def test_runs_follow_the_rows(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 100)
    assert runs_of(rows) == LEAST_RUNS and runs_of(spark.range(0, 10, 1, 3)) == 3 and runs_of(spark.range(0)) >= 1
    monkeypatch.setattr(exact, "RUN_ROWS", 20)
    assert runs_of(rows) == 50


def test_exact_dedup_small_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_ROWS", 3)
    rows = [(i, f"text {i % 10}", None, None, None, None, None, None) for i in range(200)]
    got = exact_dedup(cases.table(spark, rows, 4), "largest").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(190 + i, 20) for i in range(10)}


def test_exact_dedup_empty(spark):
    assert exact_dedup(cases.table(spark, [])).collect() == []


def brute_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    at = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            at[key(line)].add(LOWEST if r[0] is None else r[0])
    doomed = {k: max(v) for k, v in at.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        own = LOWEST if r[0] is None else r[0]
        kept = [x for x in lines if doomed.get(key(x), own) == own]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_line_dedup_against_brute_force(spark, parts):
    rows = cases.hard_rows() * 2 + [(2000 + i, "\n".join(f"a line of some length number {j % 40} here" for j in range(i, i + 9)), "de", "s", 1, None, None, None) for i in range(60)]
    got = line_dedup(cases.table(spark, rows, parts)).collect()
    assert cases.norm(got) == cases.norm(brute_lines(rows))
    assert sum(r.n_dropped for r in got) > 0


def test_line_dedup_carries_columns(spark):
    rows = cases.hard_rows()
    got = line_dedup(cases.table(spark, rows), carry=("lang", "source", "kept")).collect()
    assert cases.norm((r.doc_id, r.lang, r.source, r.kept) for r in got) == cases.norm((r[0], r[2], r[3], r[5]) for r in rows)


def test_line_dedup_empty(spark):
    assert line_dedup(cases.table(spark, [])).collect() == []


def test_tables_in_the_shared_folder(spark):
    at = common.shared_dir(spark)
    assert common.cut(spark.range(10), "x").agg(F.sum("id")).first()[0] == 45
    assert common.shared_dir(spark) == at
    mark = common.written()
    tables = [common.cut(spark.range(n), "x") for n in (3, 4, 5)]
    first, _, last = (p.removeprefix("file:") for p in common._written[mark:])
    assert common.release(spark, mark, keep=1) == 2 and not os.path.exists(first) and os.path.exists(last) and tables[2].count() == 5
    assert common.release(spark, mark) == 1 and not os.path.exists(last) and common.written() == mark


def test_no_temporary_folder_on_a_cluster():
    class Far:
        class sparkContext:
            master = "yarn"
            getConf = staticmethod(dict)

        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Far)
