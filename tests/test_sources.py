import bz2
import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_extract import brute_hashes

from motifel.functions import bits as b
from motifel.operators import colors
from motifel.plans import cli, index
from motifel.sources import fastx, rawmini, scratch, storage
from motifel.streaming import incremental

MASK = (1 << 64) - 1


def lz4(data):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "lz4") as out:
        out.write(data)
    return sink.getvalue().to_pybytes()


PACK = {"": lambda x: x, ".gz": gzip.compress, ".bz2": bz2.compress, ".lz4": lz4}
FASTA = b">one first\nACGT\nACGTN\n>two > with a sign\nacgu\n>three\n\n>four\r\nAC\r\nGT\r\n"
WANT = [("four", "ACGT"), ("one first", "ACGTACGTN"), ("three", ""), ("two > with a sign", "acgu")]
FASTQ = b"@r1\nACGTAC\n+\n@@>+II\n@r2 x\nACG\n+r2 x\n+++\n@r3\n\n+\n\n@r4\nAC\nGT\n+\n>@\n@+\n"
WANTQ = [("r1", "ACGTAC"), ("r2 x", "ACG"), ("r3", ""), ("r4", "ACGT")]


@pytest.mark.parametrize("codec", PACK)
def test_fasta(spark, tmp_path, codec):
    path = tmp_path / f"x.fasta{codec}"
    path.write_bytes(PACK[codec](FASTA))
    got = fastx.read_fastx(spark, str(path)).collect()
    assert sorted((r.header, r.seq) for r in got) == WANT and len({r.rec_id for r in got}) == 4


@pytest.mark.parametrize("codec", PACK)
@pytest.mark.parametrize("name", ["x.fastq", "x.fq"])
def test_fastq(spark, tmp_path, codec, name):
    path = tmp_path / f"{name}{codec}"
    path.write_bytes(PACK[codec](FASTQ))
    assert sorted((r.header, r.seq) for r in fastx.read_fastx(spark, str(path)).collect()) == WANTQ


def test_kind_by_content_and_empty_files(spark, tmp_path):
    (tmp_path / "a.fastx").write_bytes(FASTQ)
    (tmp_path / "b.fastx").write_bytes(FASTA)
    (tmp_path / "c.fastx").write_bytes(b"")
    paths = fastx.list_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["a.fastx", "b.fastx", "c.fastx"]
    assert fastx.read_fastx(spark, paths).count() == 8
    assert fastx.list_files(spark, str(tmp_path), max_files=2) == paths[:2]
    assert fastx.read_fastx(spark, []).count() == 0


def test_headers_are_text_and_only_line_feeds_end_lines(spark, tmp_path):
    """Bytes 0x85, 0x0b, 0x0c and 0x1c to 0x1e are no line ends."""
    text = ">Ångström\u0085x\x0b\x0c\x1c\nACGT\nAC\n>b\nGG\n".encode()
    for name in ("x.fasta", "x.fasta.lz4", "x.fastx", "y.fastx.gz"):
        (tmp_path / name).write_bytes(PACK["." + name.split(".")[2]](text) if name.count(".") > 1 else text)
        got = sorted((r.header, r.seq) for r in fastx.read_fastx(spark, str(tmp_path / name)).collect())
        assert got == [("b", "GG"), ("Ångström\u0085x\x0b\x0c\x1c", "ACGTAC")], name


def random_fastq(rng, n):
    """Records of four lines whose qualities may look like headers and separators."""
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 7, 40, 151]))) for _ in range(n)]
    want = [(f"r{i} @+", s) for i, s in enumerate(seqs)]
    text = "".join(f"@{h}\n{s}\n+{h if i % 3 else ''}\n{''.join(rng.choice('@+>I!') for _ in s)}\n" for i, (h, s) in enumerate(want))
    return want, text.encode()


@pytest.mark.parametrize("split", [50, 333, 5000])
@pytest.mark.parametrize("crlf", [False, True])
def test_a_large_fastq_file_is_read_by_many_tasks(spark, tmp_path, split, crlf):
    want, text = random_fastq(random.Random(split), 150)
    (tmp_path / "x.fastq").write_bytes(text.replace(b"\n", b"\r\n") if crlf else text)
    df = fastx.read_parts(spark, str(tmp_path / "x.fastq"), split=split)
    assert df.rdd.getNumPartitions() == -(-(tmp_path / "x.fastq").stat().st_size // split) > 1
    got = df.collect()
    assert sorted((r.header, r.seq) for r in got) == sorted(want) and len({r.rec_id for r in got}) == len(want)
    assert sorted((r.header, r.seq) for r in fastx.read_parts(spark, str(tmp_path / "x.fastq"), whole_files=True).collect()) == sorted(want)


@pytest.mark.parametrize("split", [20, 97, 1000])
def test_a_large_fasta_file_is_read_by_many_tasks(spark, tmp_path, split):
    rng = random.Random(split)
    want = [(f"s{i}>", "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 3, 60, 500])))) for i in range(60)]
    text = "".join(f">{h}\n" + "".join(f"{s[j : j + 60]}\n" for j in range(0, len(s), 60)) for h, s in want)
    (tmp_path / "x.fastx").write_text(text)
    df = fastx.read_parts(spark, str(tmp_path / "x.fastx"), split=split)
    assert df.rdd.getNumPartitions() > 1
    assert sorted((r.header, r.seq) for r in df.collect()) == sorted(want)
    assert sorted((r.header, r.seq) for r in fastx.read_fasta(spark, str(tmp_path / "x.fastx")).collect()) == sorted(want)


def test_records_of_more_lines_are_not_cut(spark, tmp_path):
    (tmp_path / "x.fastq").write_bytes(FASTQ * 20)
    with pytest.raises(Exception, match="whole_files"):
        fastx.read_parts(spark, str(tmp_path / "x.fastq"), split=100).collect()
    assert fastx.read_parts(spark, str(tmp_path / "x.fastq"), whole_files=True, split=100).count() == 80


def test_a_sequence_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(fastx, "PIECE", 100)
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(1234)).encode()
    text = b">long\n" + b"\n".join(seq[i : i + 70] for i in range(0, len(seq), 70)) + b"\n>short\nACGT\n"
    got = list(fastx.records(storage.lines(storage.memory_file(text)), None, 18))
    assert [h for h, _ in got] == [b"long"] * (len(got) - 1) + [b"short"] and all(len(s) <= 118 for _, s in got)
    mers = lambda s: [s[i : i + 19] for i in range(len(s) - 18)]
    assert sorted(m for _, s in got[:-1] for m in mers(s)) == sorted(mers(seq))


def test_blocks_and_lines(monkeypatch):
    data = b"ab\r\n\ncd\x85e\nlast"
    for size in (1, 2, 3, 100):
        monkeypatch.setattr(storage, "BLOCK", size)
        monkeypatch.setattr(storage.blocks, "__defaults__", (1, size, None))
        assert list(storage.lines(storage.memory_file(data))) == [(0, b"ab"), (4, b""), (5, b"cd\x85e"), (10, b"last")]
    assert list(storage.blocks(storage.memory_file(b"x" * 10), 4, 6)) == [b"xxxx", b"xxxx", b"xx"]
    assert list(storage.blocks(storage.memory_file(b"x" * 10), 4, 8, 9)) == [b"x" * 8, b"x"]


def test_kmer_text(spark, tmp_path):
    (tmp_path / "k.txt").write_text("ACGT\t5\nTTTT\t1\n")
    assert sorted(map(tuple, fastx.read_kmer_text(spark, str(tmp_path / "k.txt")).collect())) == [("ACGT", 5), ("TTTT", 1)]


@pytest.mark.parametrize("codec", ["", "gz", "bz2", "lz4"])
def test_raw_files(spark, tmp_path, codec):
    rng = random.Random(3)
    rows = [(b.signed(rng.getrandbits(64)), [b.signed(rng.getrandbits(64)) for _ in range(3)]) for _ in range(500)]
    df = spark.createDataFrame(rows, "minimizer long, color_words array<long>").repartition(4)
    out = str(tmp_path / "set.130c")
    assert rawmini.write_raw(df, out, "color_words", codec) == 4
    assert sorted((r.minimizer, r.color_words) for r in rawmini.read_raw(spark, out, 130).collect()) == sorted(rows)
    plain = str(tmp_path / "plain")
    rawmini.write_raw(df, plain, None, codec)
    assert sorted(r.minimizer for r in rawmini.read_raw(spark, plain).collect()) == sorted(m for m, _ in rows)
    assert rawmini.colors_in_name("a/result.130c.lz4") == 130 and rawmini.colors_in_name("x.raw") is None


def test_plain_set_files_are_read_by_many_tasks(spark, tmp_path):
    np.arange(4000, dtype="<u8").tofile(tmp_path / "x.raw")
    df = rawmini.read_raw(spark, str(tmp_path / "x.raw"), 192, split=1000)
    assert df.rdd.getNumPartitions() == -(-32000 // (1000 // 32 * 32))
    assert sorted((r.minimizer, *r.color_words) for r in df.collect()) == [(i, i + 1, i + 2, i + 3) for i in range(0, 4000, 4)]


@pytest.mark.parametrize("codec", ["", "gz"])
def test_a_part_of_a_row_is_an_error(spark, tmp_path, codec):
    path = tmp_path / ("x.raw" + (f".{codec}" if codec else ""))
    path.write_bytes(PACK[f".{codec}" if codec else ""](np.arange(7, dtype="<u8").tobytes()))
    with pytest.raises(Exception, match="whole row"):
        rawmini.read_raw(spark, str(path), 5).collect()
    with pytest.raises(Exception, match="whole row"):
        rawmini.read_sparse(spark, str(path), 100).collect()


def test_a_second_write_of_a_part_leaves_one_file(spark, tmp_path):
    out = tmp_path / "set"
    for _ in range(2):
        assert rawmini.write_raw(spark.range(0, 100, 1, 3).select(F.col("id").alias("minimizer")), str(out)) == 3
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == [f"part-{i:05d}.raw" for i in range(3)]
    assert sorted(r[0] for r in rawmini.read_raw(spark, str(out)).select("minimizer").collect()) == list(range(100))


def test_index_stream(spark, tmp_path):
    rows = [((5 << 32) | 7, [0, 64]), (-1, [3]), (1 << 31, [])]
    words = [[sum(1 << (c % 64) for c in cs if c // 64 == i) for i in range(2)] for _, cs in rows]
    df = spark.createDataFrame([(m, [b.signed(x) for x in w]) for (m, _), w in zip(rows, words, strict=True)], "minimizer long, color_words array<long>").coalesce(1)
    assert rawmini.write_index(colors.color_index(df, 128), str(tmp_path / "i")) == 1
    got = np.fromfile(tmp_path / "i" / "part-00000.idx", "<u4").tolist()
    assert got == [7, 5, 2, 0, 64, 0xFFFFFFFF, 0xFFFFFFFF, 1, 3, 1 << 31, 0, 0]


@pytest.mark.parametrize("size", [16, 64, 1 << 20])
def test_sparse_rows_in_any_order_and_blocks(tmp_path, monkeypatch, size):
    rng, layout = random.Random(size), b.SparseLayout(100)
    rows = [[rng.getrandbits(64), *[(rng.choice([1, 2, 5, 30] if i > 200 else [4]) if j == 0 else 0) << 56 for j in range(1)]] for i in range(600)]
    rows = [[m, head, *[rng.getrandbits(64) for _ in range((head >> 56) // 8)]] for m, head in rows]
    np.array([x for r in rows for x in r], "<u8").tofile(tmp_path / "s.raw")
    monkeypatch.setattr(storage.blocks, "__defaults__", (1, size, None))
    got = [(r["minimizer"], *r["packed"]) for batch in rawmini.sparse_batches(str(tmp_path / "s.raw"), layout) for r in batch.to_pylist()]
    assert [[x & MASK for x in r] for r in got] == rows


def test_no_temporary_folder_on_a_cluster(spark):
    class Far:
        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_path(Far, "x")


def test_raw_bytes_are_little_endian_words(spark, tmp_path):
    np.array([5, 1, 7, 3], "<u8").tofile(tmp_path / "x.raw")
    assert sorted((r.minimizer, r.color_words) for r in rawmini.read_raw(spark, str(tmp_path / "x.raw"), 2).collect()) == [(5, [1]), (7, [3])]


@pytest.mark.parametrize("n", [65, 100, 257, 513])
def test_sparse_files(spark, tmp_path, n):
    rng = random.Random(n)
    layout = b.SparseLayout(n)
    sets = [(b.signed(rng.getrandbits(64)), sorted(rng.sample(range(n), rng.randint(1, max(1, layout.threshold))))) for _ in range(200)]
    df = spark.createDataFrame(sets, "minimizer long, colors array<int>").repartition(3)
    rawmini.write_raw(df.select("minimizer", b.sparse_pack(F.col("colors"), layout).alias("p")), str(tmp_path / "s"), "p", "lz4")
    assert sorted((r.minimizer, r.colors) for r in rawmini.read_sparse(spark, str(tmp_path / "s"), n).collect()) == sorted(sets)


def test_hex_text(spark, tmp_path):
    rawmini.write_hex(spark.createDataFrame([(255,), (-1,)], "minimizer long"), str(tmp_path / "h"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "h")).collect()) == ["00000000000000FF", "F" * 16]


def write_samples(folder, n=5, seed=1):
    rng = random.Random(seed)
    common = "".join(rng.choice("ACGT") for _ in range(120))
    want = {}
    for i in range(n):
        seqs = [common, "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 150)))] if i != 2 else ["ACG"]
        text = "".join(f">s{j}\n{s[:60]}\n{s[60:]}\n" for j, s in enumerate(seqs))
        codec = ["", ".gz", ".bz2", ".lz4", ""][i % 5]
        (folder / f"f{i}.fasta{codec}").write_bytes(PACK[codec](text.encode()))
        for s in seqs:
            for x in brute_hashes(s, 31, 19):
                want.setdefault(x, set()).add(i)
    return want


def test_index_of_files(spark, tmp_path):
    want = write_samples(tmp_path)
    made = index.build_index(spark, fastx.list_files(spark, str(tmp_path)))
    got = {r.minimizer & MASK: set(r.l) for r in made.rows().select("minimizer", b.to_list(F.col("color_words"), 5).alias("l")).collect()}
    assert got == want and made.n_colors == 5 and made.files.count() == 5
    assert made.sparse.count() == 0 and made.dense.count() == len(want)


def test_command_line(spark, tmp_path):
    want = write_samples(tmp_path)
    out = cli.main(["-d", str(tmp_path), "-o", str(tmp_path / "res"), "-t", "8", "-M", "100", "-a", "std_4cores", "-n"], spark)
    assert out["dense"].endswith("res.5c") and spark.read.parquet(out["dense"]).count() == len(want)
    assert spark.read.parquet(out["sets"]).groupBy("color").count().count() == 4  # one sample is too short
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_stream_gives_the_same_index(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 3, "".join(rng.choice("ACGT") for _ in range(90))) for i in range(12)]
    for k in range(4):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "color int, seq string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("color int, seq string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        incremental.update_index(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.minimizer & MASK, r.color) for r in incremental.pairs(spark, str(tmp_path / "out")).collect()}
    assert got == {(x, c) for c, s in rows for x in brute_hashes(s, 31, 19)}
    incremental.compact(spark, str(tmp_path / "out"), str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == len(got)
    assert incremental.rows(spark, str(tmp_path / "out"), 3).count() == len({m for m, _ in got})


def test_colors_by_folder(spark, tmp_path):
    p = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "minimizer long, color int")
    rawmini.write_by_color(p, str(tmp_path / "c"))
    assert sorted(r.minimizer for r in spark.read.parquet(str(tmp_path / "c/color=0")).collect()) == [1, 2]
    assert colors.color_count(p) == 2


def test_a_color_is_one_file(spark, tmp_path):
    """However many tasks hold its rows; a null color has Spark's folder for it."""
    p = spark.range(0, 4000, 1, 8).select((F.col("id") * 7919 % 4000).alias("minimizer"), F.when(F.col("id") % 40 != 3, F.col("id") % 40).cast("int").alias("color"))
    at = tmp_path / "c"
    assert rawmini.write_by_color(p, str(at)) == 40
    files = sorted(f.relative_to(at).parts for f in at.rglob("*.parquet"))
    assert len(files) == len({f[0] for f in files}) == 40 and not list(at.rglob(".part*"))
    back = spark.read.schema("minimizer long, color int").parquet(str(at)).collect()
    assert sorted(map(tuple, back), key=str) == sorted(map(tuple, p.collect()), key=str)
    with pytest.raises(FileExistsError):
        rawmini.write_by_color(p, str(at))
    assert rawmini.write_by_color(p.limit(0), str(tmp_path / "none")) == 0
