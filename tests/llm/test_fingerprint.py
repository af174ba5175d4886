import hashlib

import cases
import numpy as np
import pytest

from motifel.llm import fingerprint as fp


def brute_anchors(text):
    """Closed syncmers by definition, one k-mer at a time."""
    def order(i):
        return int(fp._mix(np.frombuffer(text[i : i + fp.S], "<u8"))[0])

    out = []
    for i in range(len(text) - fp.K + 1):
        inner = [order(j) for j in range(i, i + fp.K - fp.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize("text", ["the quick brown fox jumps over the lazy dog " * 3, "aaaa" * 20, "x" * 24, "Üñïçødé " * 9])
def test_anchors_are_the_closed_syncmers(text):
    assert fp.syncmers(text.encode())[0].tolist() == brute_anchors(text.encode())


def test_anchors_do_not_depend_on_context():
    a = "some words that stand in the middle of two different texts for once".encode()
    inner = {h for h in fp.syncmers(a)[1].tolist()}
    assert inner <= set(fp.syncmers(b"0123456789 " * 5 + a + b" more of it")[1].tolist())


def test_long_texts_keep_all_anchors():
    """A passage that two long texts share, and a small edit, both show."""
    rng = np.random.default_rng(1)
    a, b, passage = (bytes(rng.integers(97, 123, n).tolist()) for n in (100_000, 100_000, 300))
    x, y = fp.sketch(a[:70_000] + passage + a[70_000:]), fp.sketch(b[:30_000] + passage + b[30_000:])
    assert len(x) == len(set(fp.syncmers(a[:70_000] + passage + a[70_000:])[1].tolist())) > 10_000
    assert fp.likeness(x, y) > 0
    changed = fp.sketch(a[:50_000] + b"a small edit" + a[50_012:])
    assert 0.99 < fp.likeness(fp.sketch(a), changed) < 1


def test_likeness_is_the_longest_common_chain():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.permutation(30)[: rng.integers(1, 30)].astype(np.uint32) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if v == w else max(table[i, j + 1], table[i + 1, j])
        assert fp.likeness(a, b) == table[-1, -1] / len({*a.tolist(), *b.tolist()})


def test_likeness_bounds():
    e = np.zeros(0, np.uint32)
    a = fp.sketch(b"one text of some length, long enough for anchors to be found in it")
    assert fp.likeness(e, e) == 1 and fp.likeness(a, a) == 1 and fp.likeness(a, e) == 0


def plain_sketch(text):
    """Whole numbers and one k-mer after another: values of the closed syncmers, each once, in order."""
    def mix(x):
        x = x * 0x9E3779B97F4A7C15 % 2**64
        x ^= x >> 29
        x = x * 0xC2B2AE3D27D4EB4F % 2**64
        return x ^ x >> 32

    words = [int.from_bytes(text[i : i + 8], "little") for i in range(len(text) - 7)]
    out = []
    for i in range(len(text) - 23):
        order = [mix(w) for w in words[i : i + 17]]
        if min(order) in (order[0], order[-1]):
            value = mix((mix((order[0] + words[i + 8]) % 2**64) + words[i + 16]) % 2**64) >> 32
            if value not in out:
                out.append(value)
    return out


def plain_likeness(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, v in enumerate(a):
        for j, w in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1] / len({*a, *b}) if a or b else 1.0


def test_sketches_and_likeness_against_plain_loops():
    texts = [t.encode() for r in cases.hard_rows() if 24 <= len(t := r[1] or "") < 1500]
    texts += [texts[0][: len(texts[0]) // 2] + texts[3], texts[3] + texts[0], texts[0] * 2]
    plain = [plain_sketch(t) for t in texts]
    for t, p in zip(texts, plain, strict=True):
        assert fp.sketch(t).tolist() == p
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert abs(fp.likeness(fp.sketch(a), fp.sketch(b)) - plain_likeness(plain[i], plain[j])) < 1e-12


def expected(rows):
    key = lambda r: (-(1 << 63) if r[0] is None else r[0])
    rows = sorted(rows, key=key)
    out = []
    for r, f in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = r[1] or "", f[1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + n[:q]
        a, b, c = fp.sketch(t.encode()), fp.sketch(changed.encode()), fp.sketch(n.encode())
        out.append((r[0], len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.hexed(a), fp.hexed(b), fp.likeness(a, b), fp.likeness(a, c)))
    return cases.norm(out)


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_against_brute_force(spark, buckets):
    rows = list({r[0]: r for r in cases.hard_rows()}.values())  # one row for each id: the order among equal ids is by a hash
    assert cases.norm(fp.fingerprints(cases.table(spark, rows), buckets=buckets).collect()) == expected(rows)


def test_repeated_ids_keep_all_rows(spark):
    rows = cases.hard_rows()
    got = fp.fingerprints(cases.table(spark, rows), buckets=5).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    # Rows of one id follow each other by a hash of their text: the same rows whatever the number of buckets.
    again = fp.fingerprints(cases.table(spark, rows, 7), buckets=2).collect()
    assert cases.norm(got) == cases.norm(again)
    order = {r.text: r.h for r in spark.createDataFrame([(r[1],) for r in rows], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], order[r[1]])
    ranked = sorted(rows, key=key)
    want = [(r[0], hashlib.sha256(((t := r[1] or "")[: len(t) - len(t) // 4] + (n[1] or "")[: len(t) // 4]).encode()).hexdigest()) for r, n in zip(ranked, ranked[1:] + ranked[:1], strict=True)]
    assert cases.norm((r.doc_id, r.edited_sha256) for r in got) == cases.norm(want)


def test_empty_table(spark):
    assert fp.fingerprints(cases.table(spark, [])).collect() == []


def test_whole_table(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = fp.fingerprints(docs).collect()
    assert cases.norm(got) == expected(rows)
    assert sum(r.near_edited > 0.35 for r in got) > 0.9 * len(got)
