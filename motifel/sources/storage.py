"""Files as the executors see them: opened by path through pyarrow's file systems, listed and
renamed on the driver through Hadoop's. Compressed ones are read and written as streams."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ends of file names that name a codec.
CODECS = {"gz": "gzip", "bz2": "bz2", "lz4": "lz4"}
BLOCK = 4 << 20
"""Bytes that are read at once."""


def extension(path: str) -> tuple[str, str]:
    """(kind, codec) by the name: ("fasta", "gz") for x.fasta.gz; ("", "gz") for x.gz."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")[1:]
    codec = parts.pop() if parts and parts[-1] in CODECS else ""
    return (parts[-1] if parts else ""), codec


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path, and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def open_in(path: str, at: int = 0) -> BinaryIO:
    """A file to read from byte ``at``; a compressed one, by its name, is unpacked as it is read and starts at 0."""
    fs, inside = file_system(path)
    codec = extension(path)[1]
    if codec:
        return pa.CompressedInputStream(fs.open_input_stream(inside, compression=None), CODECS[codec])
    f = fs.open_input_file(inside)
    f.seek(at)
    return f


def open_out(path: str, codec: str = "") -> BinaryIO:
    """A new file to write, packed by the codec; folders on the way are made."""
    fs, inside = file_system(path)
    fs.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(inside, compression=CODECS[codec] if codec else None)


def blocks(f: BinaryIO, unit: int = 1, size: int = BLOCK, most: int | None = None) -> Iterator[bytes]:
    """The bytes of f, at most ``most``, in blocks of a multiple of ``unit``; only the last may be a part of one."""
    size = max(unit, size // unit * unit)
    while most is None or most > 0:
        want = size if most is None else min(size, most)
        block = f.read(want)
        while block and len(block) < want and (more := f.read(want - len(block))):
            block += more
        if not block:
            return
        yield block
        if most is not None:
            most -= len(block)


def lines(f: BinaryIO, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place of its first byte, line) of all lines from here on, without LF or CRLF."""
    rest = b""
    for block in blocks(f):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            yield at, p[:-1] if p.endswith(b"\r") else p
            at += len(p) + 1
    if rest:
        yield at, rest[:-1] if rest.endswith(b"\r") else rest


def listing(spark: SparkSession, paths: list[str] | str) -> list[tuple[str, int]]:
    """(path with its scheme, bytes) of files, patterns, and the files of folders but hidden ones; in their order."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        found = fs.globStatus(path)
        if found is None or not len(found):
            raise FileNotFoundError(p)
        for status in found:
            inside = sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().getName()) if status.isDirectory() else [status]
            for s in inside:
                if s.isFile() and (not status.isDirectory() or not s.getPath().getName().startswith(("_", "."))):
                    out.append((s.getPath().toString(), s.getLen()))
    return out


def _count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for path in batch.column("file").to_pylist():
            with open_in(path) as f:
                counts.append(sum(block.count(b"\n") for block in blocks(f)))
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(counts, pa.int64())], ["file", "n_lines"])


def line_counts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, n_lines): the line feeds of each file, plain or compressed, read as a stream, a task a file."""
    files = [(i, p) for i, (p, _) in enumerate(listing(spark, paths))]
    dealt = spark.createDataFrame(files, "i int, file string").repartitionById(max(1, len(files)), F.col("i"))
    return dealt.select("file").mapInArrow(_count_lines, "file string, n_lines long")


def rename(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for old, new in pairs:
        a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
        fs = a.getFileSystem(conf)
        fs.delete(b, False)
        if not fs.rename(a, b):
            raise OSError(f"{old} could not become {new}")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with scheme and authority, which mean the same on every machine."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def split_bytes(spark: SparkSession) -> int:
    """Size of the parts of plain files: that of Spark's own file sources."""
    text = str(spark.conf.get("spark.sql.files.maxPartitionBytes")).lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return max(1, int(text.rstrip("kmgt")) << unit)


def memory_file(content: bytes) -> BinaryIO:
    return io.BytesIO(content)
