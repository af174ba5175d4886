"""FASTA and FASTQ files as DataFrames, plain or compressed.

* FASTA that is named so (plain, gzip, bzip2): Spark's text reader with a record separator.
* All others, FASTQ above all, LZ4 frames, and files whose kind only their first sign tells:
  the data source ``motifel_fastx``. A plain file is cut into parts of bytes, and a part's task
  reads the records that begin in it; a compressed one is one task that reads a stream. No file
  is ever held whole. Records of a FASTQ file that is cut have four lines each; a file whose
  records have more is read with ``whole_files``, one task a file.

Result: (file, rec_id, header, seq). rec_id numbers the records of a file in an arbitrary but
fixed order (by task, then by place); lines of a record go together; CRLF ends a line like LF.
With ``overlap`` a sequence longer than ``PIECE`` bases comes in several rows, each of which
repeats the last ``overlap`` bases of the one before: every (overlap + 1)-mer is in one of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motifel.sources import storage
from motifel.sources.storage import extension

#: File name extensions that count as sequence files, and as compressed.
PLAIN = ["fastx", "fasta", "fastq", "fna", "fa", "fq"]
FASTA = ["fasta", "fna", "fa"]
CODECS = ["gz", "bz2", "lz4"]
RECORD = "file string, rec_id long, header string, seq string"
PIECE = 1 << 26
ROWS, BYTES = 5000, 8 << 20
"""Of a batch at most."""


def list_files(spark: SparkSession, directory: str, extensions: list[str] | None = None, max_files: int = 65536) -> list[str]:
    """Paths of sequence files of a directory, sorted by name, at most max_files. A color is a place in this list."""
    wanted = set(extensions or [*PLAIN, *CODECS])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(directory)
    found = [s.getPath().toString() for s in folder.getFileSystem(conf).listStatus(folder) if s.isFile()]
    return sorted(p for p in found if p.rsplit(".", 1)[-1].lower() in wanted)[:max_files]


def _numbered(df: DataFrame) -> DataFrame:
    return df.select("file", F.monotonically_increasing_id().alias("rec_id"), "header", "seq")


def read_fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A record starts at a '>' that begins a line."""
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("file"), F.translate("value", "\r", "").alias("value"))
    rows = rows.where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return _numbered(rows.select("file", F.regexp_replace(head, "^>", "").alias("header"), F.translate(body, "\n", "").alias("seq")))


def records(found: Iterator[tuple[int, bytes]], end: int | None = None, overlap: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    """(header, sequence) of the records among numbered lines that begin before ``end``, FASTA or
    FASTQ. In FASTQ the quality is as long as the sequence, whatever signs it has and however many lines."""
    header, seq, size = None, [], 0
    for at, line in found:
        first = line[:1]
        if first == b">" or first == b"@" and header is None:
            if header is not None:
                yield header, b"".join(seq)
                header = None
            if end is not None and at >= end:
                return
            header, seq, size = line[1:], [], 0
        elif first == b"+" and header is not None:
            need = sum(map(len, seq))
            yield header, b"".join(seq)
            header = None
            while need > 0 and (more := next(found, None)) is not None:
                need -= len(more[1])
        elif header is not None:
            seq.append(line.strip())
            size += len(seq[-1])
            if overlap is not None and size >= PIECE + overlap:  # FASTA: a quality would need the whole length
                whole = b"".join(seq)
                while len(whole) >= PIECE + overlap:
                    yield header, whole[: PIECE + overlap]
                    whole = whole[PIECE:]
                seq, size = [whole], len(whole)
    if header is not None:
        yield header, b"".join(seq)


def four_lines(found: Iterator[tuple[int, bytes]], seek: bool, end: int) -> Iterator[tuple[bytes, bytes]]:
    """(header, sequence) of FASTQ records of four lines each that begin before ``end``. With ``seek``
    the lines may begin inside a record: the first whole one is the first whose third line begins
    with + and whose second and fourth are equally long. A quality line can begin with @, but two
    lines after it there is a sequence."""
    is_record = lambda r: len(r) == 4 and r[0][1][:1] == b"@" and r[2][1][:1] == b"+" and len(r[1][1].strip()) == len(r[3][1])
    ahead = list(islice(found, 8))
    while seek and len(ahead) >= 4 and not is_record(ahead[:4]):
        ahead.pop(0)
    if seek and len(ahead) < 4:
        if next(found, None) is not None:
            raise ValueError("no record of four lines is found here; read the file with whole_files")
        return  # the end of a record that began before
    found = chain(ahead, found)
    while r := list(islice(found, 4)):
        if r[0][0] >= end:
            return
        if not r[0][1] and not any(x[1] for x in r):
            continue  # empty lines at the end
        if len(r) == 3 and not r[1][1]:
            r.append((0, b""))  # an empty quality that no line feed ends
        if not is_record(r):
            raise ValueError(f"a record at byte {r[0][0]} does not have four lines; read the file with whole_files")
        yield r[0][1][1:], r[1][1].strip()


def _batches(path: str, found: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    def batch(rows):
        text = [[x.decode("utf-8", "replace") for x in c] for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([path] * len(rows), *text)], ["file", "header", "seq"])

    rows, size = [], 0
    for r in found:
        rows.append(r)
        size += len(r[1])
        if len(rows) == ROWS or size > BYTES:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def part_records(path: str, start: int, end: int, whole: bool, overlap: int | None) -> Iterator[tuple[bytes, bytes]]:
    """The records of a file that begin in [start, end). whole: the part is all of the file."""
    if whole:
        with storage.open_in(path) as f:
            yield from records(storage.lines(f), None, overlap)
        return
    with storage.open_in(path) as f:
        first = f.read(1 << 16).lstrip()[:1]
    with storage.open_in(path, max(0, start - 1)) as f:
        found = storage.lines(f, max(0, start - 1))
        if start:
            next(found, None)  # up to the first line that begins here or later
        if first == b"@":
            yield from four_lines(found, start > 0, end)
        else:
            begun = (x for x in found)
            for at, line in begun:  # to the first record of this part
                if line[:1] == b">" and at >= start:
                    yield from records(chain([(at, line)], begun), end, overlap)
                    break
                if at >= end:
                    break


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int, whole: bool):
        self.path, self.start, self.end, self.whole = path, start, end, whole


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.size = json.loads(options["files"]), int(options["split"])
        self.whole, self.overlap = options["whole"] == "true", int(options["overlap"]) if options.get("overlap") else None

    def partitions(self) -> list[_Part]:
        out = []
        for path, n in self.files:
            if self.whole or extension(path)[1] or n <= self.size:
                out.append(_Part(path, 0, n, True))
            else:
                out += [_Part(path, i, min(n, i + self.size), False) for i in range(0, n, self.size)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.path, part_records(partition.path, partition.start, partition.end, partition.whole, self.overlap))


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motifel_fastx"

    def schema(self) -> str:
        return "file string, header string, seq string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_parts(spark: SparkSession, paths: list[str] | str, whole_files: bool = False, overlap: int | None = None, split: int | None = None) -> DataFrame:
    """Any kind and codec; plain files in parts of ``split`` bytes (by default those of Spark's file
    sources), unless ``whole_files``."""
    files = storage.listing(spark, paths)
    if not files:
        return spark.createDataFrame([], RECORD)
    spark.dataSource.register(FastxSource)
    options = {"files": json.dumps(files), "split": str(split or storage.split_bytes(spark)), "whole": str(whole_files).lower()}
    if overlap is not None:
        options["overlap"] = str(overlap)
    return _numbered(spark.read.format("motifel_fastx").options(**options).load())


def read_fastx(spark: SparkSession, paths: list[str] | str, whole_files: bool = False, overlap: int | None = None) -> DataFrame:
    """Records of all files, each by its kind and codec. With ``overlap`` FASTA goes through the data source too."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = [p for p in paths if overlap is None and extension(p)[0] in FASTA and extension(p)[1] != "lz4"]
    others = [p for p in paths if p not in set(lines)]
    parts = ([read_fasta(spark, lines)] if lines else []) + ([read_parts(spark, others, whole_files, overlap)] if others else [])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RECORD)


def read_kmer_text(spark: SparkSession, paths: list[str] | str, sep: str = "\t") -> DataFrame:
    """(kmer, abundance) of text with one separator sign in each line."""
    return spark.read.csv(paths, sep=sep, schema="kmer string, abundance long")
