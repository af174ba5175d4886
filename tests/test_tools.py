from test_colors import fixture_set
from test_sources import write_samples

from motifel.functions import hashing
from motifel.plans import tools
from motifel.sources.generated import generated_sets


def test_generated_sets(spark):
    got = {}
    for r in generated_sets(spark, 300).collect():
        got.setdefault(r.color, []).append(r.minimizer)
    from motifel.functions.bits import signed

    assert {k: sorted(v) for k, v in got.items()} == {v: sorted({0, *(signed(v << (8 * i)) for i in range(8))}) for v in range(300)}


def test_the_round_trip_of_the_tools(spark, tmp_path):
    run = lambda *a: tools.main([str(x) for x in a], spark)
    run("generate", "-o", tmp_path, "-n", 5)
    files = [tmp_path / f"testf_{i:03d}.raw" for i in range(5)]
    report = run("merge-all", "-i", *files, "-o", tmp_path / "all.5c.lz4", "--colored").first()
    assert report.n_final == len({x for i in range(5) for x in fixture_set(i)}) and report.n_start == sum(len(fixture_set(i)) for i in range(5))
    merged = tmp_path / "all.5c.lz4"
    for i in range(5):
        assert run("extract-color", "-f", merged, "-c", 5, "-s", i, "-o", tmp_path / f"back{i}.raw").first()[0] == len(fixture_set(i))
        assert run("compare", files[i], tmp_path / f"back{i}.raw").count() == 0
    assert run("compare", files[1], files[2]).count() > 0
    assert [r.n_keys for r in run("extract-all-colors", "-f", merged, "-c", 5, "-o", tmp_path / "colors").collect()] == [len(fixture_set(i)) for i in range(5)]
    assert sum(r.occurrences for r in run("color-stats", "-f", merged, "-c", 5).collect()) == report.n_final
    assert run("dump", "-f", merged, "-c", 5).count() == run("extract-index", "-f", merged, "-c", 5).count() == run("dump", "-f", files[0]).count() + report.n_final - 1
    run("extract-index", "-f", merged, "-c", 5, "-o", tmp_path / "index.gz")
    assert list((tmp_path / "index.gz").glob("part-*.idx.gz"))
    assert run("color-top", "-f", merged, "-c", 5, "-m", 3).count() == 6
    assert run("color-sort", "-f", merged, "-c", 5, "-o", tmp_path / "sorted").count() == report.n_final
    two = run("merge", merged, files[0], "-c", 5, "-o", tmp_path / "six.6c.gz").first()
    assert two.n_final == report.n_final
    assert run("extract-color", "-f", tmp_path / "six.6c.gz", "-c", 6, "-s", 5, "-o", tmp_path / "b5.raw").first()[0] == 1
    assert run("merge", files[1], files[2], "-o", tmp_path / "plain.raw").first().n_final == len({*fixture_set(1), *fixture_set(2)})


def test_check_sorted_of_files(spark, tmp_path):
    from motifel.functions import bits as b
    from motifel.operators import order
    from motifel.sources import rawmini
    from pyspark.sql import functions as F

    check = lambda *a: tuple(tools.main(["check-sorted", "-f", *map(str, a)], spark).first())
    rows = spark.createDataFrame([(x,) for x in (5, 1, -1, 3)], "minimizer long").coalesce(1)
    tools.store(rows, str(tmp_path / "sorted"), None)
    rawmini.write_raw(rows, str(tmp_path / "not"))
    assert check(tmp_path / "sorted") == (4, 0) and check(tmp_path / "not") == (4, 2)
    layout = b.SparseLayout(100)
    lists = spark.createDataFrame([(9, [1]), (2, [0, 5]), (1, [7]), (4, [99])], "minimizer long, colors array<int>").repartition(3)
    pack = lambda df, name: rawmini.write_raw(df.select("minimizer", b.sparse_pack(F.col("colors"), layout).alias("p")), str(tmp_path / name), "p")
    pack(order.sort_sparse(lists), "s")
    pack(lists.orderBy("minimizer").coalesce(1), "t")
    assert check(tmp_path / "s", "-c", 100, "--sparse") == (4, 0) and check(tmp_path / "t", "-c", 100, "--sparse") == (4, 2)


def test_tools_on_sequences(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = write_samples(tmp_path / "in")
    files = sorted(str(p) for p in (tmp_path / "in").iterdir())
    assert tools.main(["minimizer-set", "-i", *files, "-o", str(tmp_path / "m.raw")], spark).count() == len(want)
    assert tools.load(spark, str(tmp_path / "m.raw"), 0).count() == len(want)
    run = lambda *a: tools.main([str(x) for x in a], spark)
    assert run("minimizer-set", "-i", *files, "-o", tmp_path / "n.raw", "--save-debug", "--do-not-save-output").count() == len(want)
    assert not (tmp_path / "n.raw").exists()
    runs = tools.load(spark, str(tmp_path / "n.raw.unsorted"), 0)
    assert {r[0] & (1 << 64) - 1 for r in runs.collect()} == set(want) and runs.count() >= len(want)
    assert run("totals", "-i", *files).first().n_bytes == sum((tmp_path / "in" / f).stat().st_size for f in files)
    lines = {r.file.rsplit("/", 1)[-1].split(".")[0]: r.n_lines for r in run("line-count", "-i", *files).collect()}
    assert lines == {f"f{i}": 6 if i != 2 else 3 for i in range(5)}
    assert run("value-length", "-f", files[0]).first().k == len(">s0")
    stats = tools.main(["kmers", "-i", *files, "-o", str(tmp_path / "k.parquet")], spark).first()
    assert stats.n_sequences == 9 and spark.read.parquet(str(tmp_path / "k.parquet")).count() == stats.n_unique
    assert tools.main(["encode", "ACTG"], spark).first().code == 27


def test_hashes_of_kmers(spark):
    df = spark.createDataFrame([("ACGTACGTACGTACG",), ("T" * 15,)], "kmer string")
    back = hashing.hash_to_kmer(hashing.kmer_to_hash(df, "kmer", "h", 15), "h", "back", 15).collect()
    assert all(r.kmer == r.back for r in back)
