import random

import pytest
from pyspark.sql import functions as F
from test_functions import pure_murmur

from motifel.functions.bits import hex16
from motifel.operators import extract

MASK = (1 << 64) - 1


def runs(seq):
    out, cur = [], ""
    for c in (seq or "").replace("\n", ""):
        c = {"a": "A", "c": "C", "g": "G", "t": "T", "u": "T", "U": "T"}.get(c, c)
        if c in "ACGT":
            cur += c
        else:
            out.append(cur)
            cur = ""
    return [r for r in [*out, cur] if r]


def canon(mer):
    code = lambda s: int("".join(str("ACTG".index(c)) for c in s), 4)
    return min(code(mer), code(mer[::-1].translate(str.maketrans("ACTG", "TGAC"))))


def brute_hashes(seq, k, m):
    out = []
    for run in runs(seq):
        for i in range(len(run) - k + 1):
            out.append(min(pure_murmur(canon(run[j : j + m])) for j in range(i, i + k - m + 1)))
    return out


def sequences(seed=1, n=25):
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    fixed = ["", None, "N" * 50, "A" * 60, dna(30), dna(31), dna(32), dna(40) + "N" + dna(40), dna(50).lower(), dna(50).replace("T", "U"), dna(20) + "\n" + dna(30), dna(20) + "\r\n" + dna(45), "-" + dna(64) + "*"]
    return [(i, s) for i, s in enumerate(fixed + [dna(rng.randint(0, 200)) for _ in range(n)])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sequences(), "id long, seq string").repartition(3)


@pytest.mark.parametrize("k,m", [(31, 19), (5, 5), (8, 3), (32, 32), (4, 1)])
def test_hashes_against_brute_force(spark, table, k, m):
    got = {(r.id, r.minimizer & MASK) for r in extract.minimizer_hashes(table, ["id"], k, m).collect()}
    assert got == {(i, x) for i, s in sequences() for x in brute_hashes(s, k, m)}
    one = {r.minimizer & MASK for r in extract.minimizer_hashes(table, [], k, m).collect()}
    assert one == {x for _, x in got}


@pytest.mark.parametrize("k,m", [(31, 19), (8, 3)])
def test_windows_say_the_same_as_the_kernel(spark, table, k, m):
    pieces = extract.seq_fragments(table, min_length=k)
    window = sorted((r.id, r.frag_id, r.pos, r.minimizer) for r in extract.window_hashes(pieces, ["id", "frag_id"], k, m).collect())
    kernel = sorted((r.id, r.frag_id, r.pos, r.minimizer) for r in extract.placed_hashes(pieces, ["id", "frag_id"], k, m).collect())
    assert window == kernel and len(kernel) > 100
    lagged = sorted((r.id, r.frag_id, r.pos) for r in extract.minimizer_runs(extract.window_hashes(pieces, ["id", "frag_id"], k, m), ["id", "frag_id"]).collect())
    assert lagged == sorted((r.id, r.frag_id, r.pos) for r in extract.placed_hashes(pieces, ["id", "frag_id"], k, m, runs=True).collect())


def test_strands_do_not_matter(spark, table):
    from motifel.functions.dna import clean, revcomp

    back = table.select("id", revcomp(clean(F.col("seq"))).alias("seq"))
    assert {r[0] for r in extract.minimizer_hashes(table, []).collect()} == {r[0] for r in extract.minimizer_hashes(back, []).collect()}


@pytest.mark.parametrize("k", [1, 3, 27, 32])
def test_kmers_against_brute_force(spark, table, k):
    want = {}
    for _, s in sequences():
        for run in runs(s):
            for i in range(len(run) - k + 1):
                x = canon(run[i : i + k])
                want[x] = want.get(x, 0) + 1
    assert {r.kmer & MASK: r.cnt for r in extract.kmer_counts(extract.kmers(table, [], k)).collect()} == want
    r = extract.kmer_stats(table, k).first()
    invalid = sum(sum(c not in "ACGTUacgtu\n" for c in s or "") for _, s in sequences())
    assert tuple(r) == (sum(s is not None for _, s in sequences()), sum(want.values()), len(want), invalid)


def test_chunks_and_windows_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGTN" if i % 97 == 0 else "ACGT") for i in range(5000))
    df = spark.createDataFrame([(1, seq), (2, seq[:100])], "id long, seq string").coalesce(1)
    whole = {(r.id, r.minimizer) for r in extract.minimizer_hashes(df, ["id"]).collect()}
    counts = {r.kmer: r.cnt for r in extract.kmer_counts(extract.kmers(df, [], 21)).collect()}
    assert {(r.id, r.minimizer) for r in extract.minimizer_hashes(extract.split_windows(df, 31, starts=100), ["id"]).collect()} == whole
    assert {r.kmer: r.cnt for r in extract.kmer_counts(extract.kmers(extract.split_windows(df, 21, starts=77), [], 21)).collect()} == counts
    placed = sorted(map(tuple, extract.placed_hashes(df, ["id"]).collect()))
    alone = sorted(map(tuple, extract.placed_hashes(df, ["id"], runs=True).collect()))
    # Kernels run in worker processes, so a small chunk is tried here directly.
    monkeypatch.setattr(extract, "CHUNK", 300)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "seq": [seq, seq[:100]]})
    for how, want in (("all", placed), ("runs", alone)):
        rows = [r for b in extract._kernel(["id"], "seq", 31, 19, how)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(rows) == want


def test_empty_and_bad_sizes(spark):
    empty = spark.createDataFrame([], "id long, seq string")
    assert extract.minimizer_hashes(empty, ["id"]).count() == 0 and extract.kmers(empty, ["id"]).count() == 0
    assert tuple(extract.kmer_stats(empty, 5).first()) == (0, 0, 0, 0)
    for k, m in ((0, 1), (33, 5), (5, 6), (5, 0)):
        with pytest.raises(ValueError):
            extract.minimizer_hashes(empty, ["id"], k, m)


def test_hex(spark):
    assert spark.range(1).select(hex16(F.lit(-1).cast("long"))).first()[0] == "F" * 16
