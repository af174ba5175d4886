"""From sequences to k-mers and window hashes.

``records``: any DataFrame with a sequence column. The kernels run over Arrow batches, in numpy;
``window_hashes`` says the same with window functions only and is the readable definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifel.functions import dna
from motifel.functions.bits import unsigned_key
from motifel.functions.hashing import murmur
from motifel.operators import kernels

K, M = 31, 19
CHUNK = 1 << 20
"""Bases that a kernel looks at at once: bounds its memory whatever the length of a sequence."""
BATCH_BASES = 1 << 21


def check_sizes(k: int, m: int | None = None) -> None:
    if not 1 <= k <= dna.MAX_K or m is not None and not 1 <= m <= k:
        raise ValueError(f"sizes must hold 1 <= m <= k <= {dna.MAX_K}; k is {k}, m is {m}")


def seq_fragments(records: DataFrame, seq: str = "seq", min_length: int = 1) -> DataFrame:
    """A row per maximal run of valid bases, with its number in the record from 0 as frag_id."""
    rest = [c for c in records.columns if c != seq]
    return records.select(*rest, F.posexplode(dna.fragments(F.col(seq))).alias("frag_id", "seq")).where(F.length("seq") >= min_length)


def split_windows(records: DataFrame, k: int, seq: str = "seq", starts: int = CHUNK) -> DataFrame:
    """Long sequences as windows of ``starts`` k-mer starts each (and k - 1 bases more), so that one
    genome is work for many tasks. Every k-mer is in exactly one window: counts stay right."""
    n = F.length(seq)
    last = F.greatest(F.ceil((n - (k - 1)) / starts), F.lit(1)).cast("int") - 1
    rest = [c for c in records.columns if c != seq]
    cut = records.select(*rest, seq, F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return cut.select(*rest, "window", F.substring(F.col(seq), F.col("window") * starts + 1, F.lit(starts + k - 1)).alias(seq))


def _chunks(seqs: list[bytes], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(codes, starts in them, first sequence, bases of it before) of some sequences at a time, long ones in parts that overlap by k - 1."""
    part, size, first = [], 0, 0
    for i, s in enumerate(seqs):
        if len(s) > CHUNK + k:
            if part:
                yield *kernels.codes(part), first, 0
            for at in range(0, len(s) - k + 1, CHUNK):
                yield *kernels.codes([s[at : at + CHUNK + k - 1]]), i, at
            part, size, first = [], 0, i + 1
            continue
        part.append(s)
        size += len(s)
        if size > BATCH_BASES:
            yield *kernels.codes(part), first, 0
            part, size, first = [], 0, i + 1
    if part:
        yield *kernels.codes(part), first, 0


def _joined(seqs) -> list[bytes]:
    return [(s or b"").replace(b"\n", b"") for s in seqs]


def _kernel(names: list[str], seq: str, k: int, m: int | None, how: str):
    """Rows (names..., pos, value) for each k-mer or minimizer. how: "all"; "distinct", each value once
    in a chunk of a record, without pos; "counted", the same with how often it is there as n; "runs",
    without those that repeat the one before. Without names a chunk of many records counts as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = _joined(b.column(seq).cast(pa.binary()).to_pylist())
            last = None  # (row, value) that the chunk before ended with
            for code, starts, first, before in _chunks(seqs, k):
                at, values = kernels.kmer_values(code, k) if m is None else kernels.minimizer_hashes(code, k, m)
                own = np.searchsorted(starts, at, "right") - 1
                row, pos, n = first + own, at - starts[own] + before + 1, None
                if how != "all" and len(row):
                    if how in ("distinct", "counted"):
                        if how == "distinct":  # most hashes repeat the one before
                            new = np.concatenate([[True], (row[1:] != row[:-1]) | (values[1:] != values[:-1])])
                            row, values = row[new], values[new]
                        if not names:
                            row = np.zeros(len(row), row.dtype)
                        ends = np.flatnonzero(np.diff(row, append=-1)) + 1
                        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                            values[i:j].sort()
                    new = np.concatenate([[last != (row[0], values[0])], (row[1:] != row[:-1]) | (values[1:] != values[:-1])])
                    if how == "runs":
                        last = (row[-1], values[-1])
                    if how == "counted":
                        n = np.diff(np.append(np.flatnonzero(new), len(new)))
                    row, values, pos = row[new], values[new], pos if how in ("distinct", "counted") else pos[new]
                for i in range(0, len(row), 100_000):
                    part = slice(i, i + 100_000)
                    rows = b.select(names).take(pa.array(row[part])).columns if names else []
                    place = [] if how in ("distinct", "counted") else [pa.array(pos[part])]
                    count = [pa.array(n[part])] if n is not None else []
                    yield pa.RecordBatch.from_arrays([*rows, *place, pa.array(values[part].view(np.int64)), *count], [*names, *["pos"][: len(place)], "value", *["n"][: len(count)]])

    return run


def _run(records: DataFrame, keep: list[str], seq: str, k: int, m: int | None, how: str, out: str) -> DataFrame:
    base = records.select(*[F.col(c) for c in keep], F.col(seq).cast("string").alias(seq))
    kinds = dict(base.dtypes)
    more = {"distinct": ["value long"], "counted": ["value long", "n long"]}.get(how, ["pos long", "value long"])
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *more])
    return base.mapInArrow(_kernel(keep, seq, k, m, how), schema).withColumnRenamed("value", out)


def kmers(records: DataFrame, keep: list[str], k: int = 27, seq: str = "seq") -> DataFrame:
    """(keep..., kmer): every canonical k-mer, as often as it is there. Null and short sequences give none."""
    check_sizes(k)
    return _run(records, keep, seq, k, None, "all", "kmer").drop("pos")


def counted_kmers(records: DataFrame, keep: list[str], k: int = 27, seq: str = "seq") -> DataFrame:
    """(keep..., kmer, n): every canonical k-mer with its number. The kernel counts inside a record (without
    keep inside a batch of records) before anything moves."""
    check_sizes(k)
    found = _run(records, keep, seq, k, None, "counted", "kmer")
    return found.groupBy(*keep, "kmer").agg(F.sum("n").alias("n"))


def minimizer_hashes(records: DataFrame, keep: list[str], k: int = K, m: int = M, seq: str = "seq") -> DataFrame:
    """(keep..., minimizer), each once: of each valid k-mer the unsigned smallest hash of its canonical m-mers.

    The kernel leaves out repeats inside a record before anything moves; ``distinct`` does the
    rest with partial aggregation. Null and short sequences give none.
    """
    check_sizes(k, m)
    return _run(records, keep, seq, k, m, "distinct", "minimizer").distinct()


def placed_hashes(records: DataFrame, keep: list[str], k: int = K, m: int = M, seq: str = "seq", runs: bool = False) -> DataFrame:
    """(keep..., pos, minimizer) of each valid k-mer of a record, pos from 1; with runs without those
    that repeat the one before, as written before any sort."""
    check_sizes(k, m)
    return _run(records, keep, seq, k, m, "runs" if runs else "all", "minimizer")


def pieces(records: DataFrame, keep: list[str], k: int, seq: str = "seq", starts: int = 256) -> DataFrame:
    """(keep..., pos, mer): the text of each run of k bases, pos from 1. Sequences go through short
    windows, as a substring is found by counting from the start of its text."""
    short = split_windows(records.where(F.length(seq) >= k).select(*keep, seq), k, seq, starts)
    each = F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda p: F.substring(F.col(seq), p, F.lit(k)))
    return short.select(*keep, "window", F.posexplode(each).alias("at", "mer")).select(*keep, (F.col("window") * starts + F.col("at") + 1).alias("pos"), "mer")


def hash_positions(records: DataFrame, keep: list[str], m: int, seq: str = "seq") -> DataFrame:
    """(keep..., pos, hash): the hash of the canonical m-mer at each place of clean fragments, with columns only."""
    piece = pieces(records, keep, m, seq)
    both = piece.select(*keep, "pos", dna.encode(F.col("mer"), m).alias("f"), dna.encode(dna.revcomp(F.col("mer")), m).alias("r"))
    return murmur(both.select(*keep, "pos", dna.canonical(F.col("f"), F.col("r")).alias("mer")), "mer", "hash").drop("mer")


def window_hashes(records: DataFrame, keep: list[str], k: int = K, m: int = M, seq: str = "seq") -> DataFrame:
    """(keep..., pos, minimizer) of each k-mer of clean fragments, by a window of k - m + 1 hashes. keep must name each fragment."""
    check_sizes(k, m)
    frame = Window.partitionBy(*keep).orderBy("pos").rowsBetween(m - k, 0)
    hashes = hash_positions(records, keep, m, seq)
    least = hashes.withColumn("minimizer", unsigned_key(F.min(unsigned_key(F.col("hash"))).over(frame)))
    return least.where(F.col("pos") > k - m).select(*keep, (F.col("pos") - (k - m)).alias("pos"), "minimizer")


def minimizer_runs(placed: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., pos, minimizer) without those that repeat the one before, as written before any sort."""
    before = F.lag("minimizer").over(Window.partitionBy(*keep).orderBy("pos"))
    return placed.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("minimizer"))).drop("before")


def kmer_counts(found: DataFrame) -> DataFrame:
    """(kmer, cnt) of all rows."""
    return found.groupBy("kmer").agg(F.count("*").alias("cnt"))


def _tallied(seq: str, k: int):
    """Rows (kmer, n, n_sequences, n_invalid): distinct k-mers of a batch with their numbers, and one row without a k-mer for its sequences."""
    count = _kernel([], seq, k, None, "counted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kmer", "n", "n_sequences", "n_invalid"]
        for b in batches:
            for found in count(iter([b])):
                zeros = pa.array(np.zeros(found.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([found.column("value"), found.column("n"), zeros, zeros], names)
            column = b.column(seq)
            bad = kernels.invalid_signs(_joined(column.cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([x]) for x in (0, len(column) - column.null_count, bad))], names)

    return run


def kmer_stats(records: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row: n_sequences, n_kmers, n_unique, n_invalid (characters that are no base) over all records, which are read once."""
    check_sizes(k)
    base = records.select(F.col(seq).cast("string").alias(seq))
    tallied = base.mapInArrow(_tallied(seq, k), "kmer long, n long, n_sequences long, n_invalid long")
    per = tallied.groupBy("kmer").agg(*[F.sum(c).alias(c) for c in ("n", "n_sequences", "n_invalid")])
    zero = F.lit(0).cast("long")
    total = lambda c, out: F.coalesce(F.sum(c), zero).alias(out)
    return per.agg(total("n_sequences", "n_sequences"), total("n", "n_kmers"), F.count("kmer").alias("n_unique"), total("n_invalid", "n_invalid"))


def sorted_unsigned(df: DataFrame, column: str) -> DataFrame:
    """Ascending as unsigned values: a range-partitioned sort."""
    return df.orderBy(unsigned_key(F.col(column)))


