import random
import zlib

import cases
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from motifel.llm import quality


def auc(score, y):
    score, y = np.array(score), np.array(y)
    better = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    return better + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()


def test_held_out_rows(spark, data_dir):
    big = data_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.classify(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    y = [label[r.doc_id] for r in held]
    assert auc([r.score for r in held], y) > 0.97
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97
    assert np.mean([(r.score - label[r.doc_id]) ** 2 for r in held]) < 0.03  # the probabilities mean what they say


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, data_dir):
    docs, labels = spark.read.parquet(f"{data_dir}/documents.parquet"), spark.read.parquet(f"{data_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("none"))
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(other, turned).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_hard_cases(spark):
    rows = cases.hard_rows()
    docs = cases.table(spark, rows)
    labels = spark.createDataFrame([(i * 3, i % 2, None) for i in range(20)] + [(None, 1, None), (3, None, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, carry=("text", "kept", "size")).collect()
    assert cases.norm((r.doc_id, r.text, r.kept, r["size"]) for r in got) == cases.norm((r[0], r[1], r[5], r[6]) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.text or "", r.score) == r.score
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(cases.table(spark, []), labels).collect() == []


def test_whole_shapes_count():
    a, b = (quality.Terms()(t)[1][0] for t in (b"http://a.b.c/d/e/f", b"http://a.b.c/d/9"))
    assert a != b


def test_words_have_the_buckets_of_the_general_rule():
    import re

    import xxhash

    rng, terms = random.Random(2), quality.Terms()
    signs = "abzABZ019 .,_-'!\x01\x7f/" + "éÉßñÑØøЖж日٣½ª×İ\u00ad\ufffd"
    words = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))).replace(" ", "") for _ in range(3000)] + ["http://a.b/C9", "___", "a_b", "--x--", "A1a2"]
    for w in words:
        shape = w
        for pattern, sign in quality._SHAPE:
            shape = pattern.sub(sign, shape)
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
        half = quality.TERMS // 2
        assert terms.both(w.encode()) == xxhash.xxh3_64_intdigest(bare) % quality.TERMS * half + xxhash.xxh3_64_intdigest(shape) % half, w


def test_word_vectors_cover_all_documents(spark):
    """Also texts without a label; sums against a plain loop."""
    texts = [cases.prose(random.Random(i), 40) for i in range(6)] + ["quokka wombat numbat quokka", "x", ""]
    docs = cases.table(spark, [(i, t, None, None, None, None, None, None) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    vectors, _ = quality.fit(docs, labels)
    terms = quality.Terms()
    for kind in (0, 1):
        own = quality.index_vectors(kind + 1)
        want = np.zeros(own.shape)
        for t in texts:
            ids = terms(t.encode())[kind]
            for i in range(len(ids)):
                for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                    if i != j:
                        want[ids[i]] += own[ids[j]]
        size = np.linalg.norm(want, axis=1, keepdims=True)
        bare = own / np.linalg.norm(own, axis=1, keepdims=True).clip(1)
        assert np.allclose(vectors[kind], bare + want / np.maximum(size, 1e-9), atol=1e-6)
        assert np.abs(vectors[kind] - bare)[terms(b"wombat")[kind]].max() > 0


def test_sums_do_not_depend_on_blocks(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([cases.prose(random.Random(i), i) for i in range(60)])], ["text"])

    def sums():
        out = {}
        for b in quality._contexts(iter([batch])):
            for k, c, x in zip(*(b.column(n).to_pylist() for n in ("kind", "chunk", "sums")), strict=True):
                out[k, c] = out.get((k, c), 0) + np.frombuffer(x, np.int32).astype(np.int64)
        return out

    whole = sums()
    monkeypatch.setattr(quality, "BLOCK", 7)
    monkeypatch.setattr(quality, "FULL", 100)
    parts = sums()
    assert whole.keys() == parts.keys() and all((whole[k] == parts[k]).all() for k in whole)


def test_temperature_is_fitted_on_rows_not_learnt_from():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(2000, 6)), np.full((2000, 1), 1000.0)])
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y)
    p = net.scores(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        some = (p >= low) & (p < low + 0.2)
        assert abs(y[some].mean() - p[some].mean()) < 0.12


def test_scores_against_a_plain_loop(spark):
    """Pooling and the forward pass, one number after another, from the vectors and weights of a fit."""
    rng = random.Random(3)
    rows = [(i, cases.prose(rng, rng.randint(0, 30)) + (" 12 34 !!" if i % 2 else ""), None, None, None, None, None, None) for i in range(40)]
    docs, labels = cases.table(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    vectors, net = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    terms, d = quality.Terms(), quality.DIM
    for i, text, *_ in rows:
        kinds = [k.tolist() for k in terms(text.encode())]
        x = [sum(float(vectors[k][t][j]) for t in kinds[k]) / max(1, len(kinds[k])) for k in (0, 1) for j in range(d)]
        n = len(text.split())
        z = [(x[j] - net.mean[j]) / net.scale[j] * n / (n + quality.PRIOR) for j in range(2 * d)]
        hidden = [np.tanh(sum(z[j] * net.w1[j][h] for j in range(2 * d)) + net.b1[h]) for h in range(len(net.b1))]
        logit = sum(hidden[h] * net.w2[h] for h in range(len(hidden))) + net.b2
        assert abs(got[i] - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-5


def test_rows_of_repeated_ids_are_bounded(spark, monkeypatch):
    seen = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(x)) or real(x, y))
    rows = [(i % 7, cases.prose(random.Random(i % 50), 8), None, None, None, None, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    got = quality.classify(cases.table(spark, rows), labels, max_train=30).collect()
    assert len(got) == 400 and seen == [30]
