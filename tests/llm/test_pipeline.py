import importlib
import sys
from collections import Counter
from pathlib import Path

import cases
import pytest
from pyspark.sql import functions as F
from test_exact_and_lines import brute_lines
from test_ngram_join import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{data_dir}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, data_dir).write.parquet(f"{at}/{name}")
        done = spark.read.parquet(f"{at}/{name}")
        out.append((name, docs, done))
        docs = done
    return out


def test_shape(stages):
    assert [n for n, _, _ in stages] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    assert all(sorted(done.columns) == sorted(corpus_pipeline.COLUMNS) for _, _, done in stages[:-1])


def test_quality_keeps_clean_documents(stages, spark, data_dir):
    _, before, after = stages[0]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    good, bad = [k for k, v in label.items() if v == 1], [k for k, v in label.items() if v == 0]
    assert sum(k in kept for k in good) >= 0.97 * len(good) and sum(k in kept for k in bad) <= 0.2 * len(bad)


def test_lines(stages):
    _, before, after = stages[1]
    want = {r[0]: r[1] for r in brute_lines([(r.doc_id, r.text) for r in before.collect()])}
    rows = after.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    groups = brute([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in groups if d == c)
    same = {r.doc_id: r for r in before.collect()}
    assert all(r == same[r.doc_id] for r in after.collect())


def test_mixing_takes_copies(stages):
    _, before, after = stages[3]
    from motifel.llm.mixing import mix

    assert Counter(r.doc_id for r in after.collect()) == Counter({r.doc_id: r.copies for r in mix(before).collect() if r.copies})


def test_packing(stages):
    import test_packing

    _, before, after = stages[4]
    test_packing.check([(r.doc_id, r.text) for r in before.collect()], after.collect(), 2048)


def test_run_gives_the_same_rows(stages, spark, data_dir):
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, data_dir)) == key(stages[-1][2])


def test_hard_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing further columns: each stage's rows are those of its rule."""
    import test_packing
    from motifel.llm.mixing import mix

    rows = cases.hard_rows()
    spark.createDataFrame([(i * 3, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id, r.text, r.lang, r.source, r.n_chars)

    docs = cases.table(spark, rows)  # with columns kept, size, row
    kept = stage["quality_classifier"](spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS and cases.norm(key(r) for r in kept.collect()) == cases.norm(r[:5] for r in rows)  # labels are all 1
    lines = stage["line_dedup"](spark, docs, str(tmp_path)).collect()
    assert cases.norm((r.doc_id, r.text) for r in lines) == cases.norm((d, t) for d, t, *_ in brute_lines(rows)) and all(r.n_chars == len(r.text) for r in lines)
    one = stage["ngram_jaccard_join"](spark, docs, str(tmp_path)).collect()
    groups = brute([(r[0], r[1]) for r in rows])
    stays = {d for d, _, c in groups if d == c}
    assert cases.norm(key(r) for r in one) == cases.norm(r[:5] for r in rows if r[0] in stays)
    mixed = stage["source_mixing"](spark, docs, str(tmp_path)).collect()
    want = Counter()
    for r in mix(docs, carry=("text",)).collect():
        want[r.doc_id, r.text, r.source] += r.copies
    assert Counter((r.doc_id, r.text, r.source) for r in mixed) == +want
    words = Counter()
    for r in mixed:
        words[r.source] += len((r.text or "").split())
    for r in mix(docs).groupBy("source").agg(F.max("target").alias("t"), F.max("size").alias("most")).collect():
        assert abs(words[r.source] - r.t) <= max(20, 0.01 * r.t, r.most / 2), r  # whole copies of one long document
    packed = stage["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert test_packing.check([(r[0], r[1]) for r in rows], packed, 2048) >= 1

    empty = docs.where(F.lit(False))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).collect() == [], name
