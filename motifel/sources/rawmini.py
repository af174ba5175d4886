"""Stored sets: flat little-endian 64-bit words, plain or compressed by file name, and hex text.

Dense files hold rows of 1 + W words, sparse ones a minimizer and packed colors of a length that
the first field tells. Neither has a header: the number of colors is the caller's to know, or
stands in the name as ``.<N>c``. Parquet is the native form; these are for exchange.

Readers are data sources: plain dense files are cut into parts of whole rows, one task each;
sparse and compressed ones are read as streams, one task a file, in blocks. Writers run in the
tasks of the rows: each writes its part file under a temporary name, and the driver renames
those of the tasks that Spark counts, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from motifel.functions import bits as b
from motifel.sources import storage
from motifel.sources.storage import extension

ROWS = 50_000
"""Of a batch at most."""


def colors_in_name(path: str) -> int | None:
    m = re.search(r"\.(\d+)c(?:\.|$)", path.rsplit("/", 1)[-1])
    return int(m[1]) if m else None


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(values), pa.int64()))


def _nonzero(rows: np.ndarray) -> pa.Array:
    """The color words of rows that are not 0, with their places (bits.NONZERO)."""
    at = np.flatnonzero(rows)
    row, place = np.divmod(at, rows.shape[1])
    row, place, at = (x[place > 0] for x in (row, place, at))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))])
    entries = pa.StructArray.from_arrays([pa.array(place - 1, pa.int32()), pa.array(rows.ravel()[at], pa.int64())], ["i", "w"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def dense_batches(path: str, start: int, size: int | None, n_words: int, nonzero: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of the bytes from ``start`` on, ``size`` of them or all, with all words or those that are not 0. A part of a row at the end is an error: the number of colors is not that of the file."""
    row = 8 * (1 + n_words)
    with storage.open_in(path, start) as f:
        for block in storage.blocks(f, row, most=size):
            if len(block) % row:
                raise ValueError(f"{path} does not end with a whole row of {1 + n_words} words")
            rows = np.frombuffer(block, "<i8").reshape(-1, 1 + n_words)
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                words = _nonzero(part) if nonzero else _lists(np.arange(len(part) + 1) * n_words, part[:, 1:].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(np.ascontiguousarray(part[:, 0])), words], ["file", "minimizer", "nonzero" if nonzero else "color_words"])


def row_starts(words: np.ndarray, per_word: int, width: int) -> tuple[np.ndarray, int]:
    """Where the sparse rows begin that lie whole in words, and where the last of them ends.
    Neighbours mostly have as many words as each other, as files are sorted by count: a run of
    such rows is found at once, in steps that double while it goes on."""
    u, at, step, out = words.view(np.uint64), 0, 1, []
    shift = np.uint64(64 - width)
    while at + 1 < len(u):
        n = 2 + int(u[at + 1] >> shift) // per_word
        most = min(step, (len(u) - at) // n)
        if not most:
            break
        here = u[at + 1 : at + most * n : n] >> shift
        same = here // np.uint64(per_word) == n - 2
        run = most if same.all() else int(np.argmin(same))
        out.append(np.arange(at, at + run * n, n))
        at += run * n
        step = 2 * step if run == step else max(1, run)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


def sparse_batches(path: str, layout: b.SparseLayout) -> Iterator[pa.RecordBatch]:
    """Rows (file, minimizer, packed) of a file, read in blocks; what a block ends with goes before the next."""
    rest = np.zeros(0, "<i8")
    with storage.open_in(path) as f:
        for block in storage.blocks(f, 8):
            if len(block) % 8:
                raise ValueError(f"{path} does not end with a whole word")
            words = np.concatenate([rest, np.frombuffer(block, "<i8")])
            starts, end = row_starts(words, layout.per_word, layout.width)
            ends = np.append(starts[1:], end)
            for i in range(0, len(starts), ROWS):
                at, to = starts[i : i + ROWS], ends[i : i + ROWS]
                part = words[at[0] : to[-1]]
                rest_of = np.ones(len(part), bool)
                rest_of[at - at[0]] = False
                packed = _lists(np.concatenate([[0], np.cumsum(to - at - 1)]), part[rest_of])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(np.ascontiguousarray(words[at])), packed], ["file", "minimizer", "packed"])
            rest = words[end:]
    if len(rest):
        raise ValueError(f"{path} does not end with a whole row of a list of {layout.n_colors} colors")


class _Part(InputPartition):
    def __init__(self, path: str, start: int, size: int | None):
        self.path, self.start, self.size = path, start, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.sparse, self.nonzero = json.loads(options["files"]), options["sparse"] == "true", options["nonzero"] == "true"
        self.n_words, self.split = int(options["words"]), int(options["split"])
        self.layout = json.loads(options["layout"])

    def partitions(self) -> list[_Part]:
        out, row = [], 8 * (1 + self.n_words)
        step = max(1, self.split // row) * row
        for path, n in self.files:
            if self.sparse or extension(path)[1]:
                out.append(_Part(path, 0, None))
                continue
            if n % row:
                raise ValueError(f"{path} has {n} bytes, not whole rows of {1 + self.n_words} words")
            out += [_Part(path, i, min(step, n - i)) for i in range(0, n, step)]
        return out or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        if self.sparse:
            n, parts = self.layout
            yield from sparse_batches(partition.path, b.SparseLayout(n, tuple(parts) if parts else None))
        else:
            yield from dense_batches(partition.path, partition.start, partition.size, self.n_words, self.nonzero)


class RawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "motifel_raw"

    def schema(self) -> str:
        if self.options["nonzero"] == "true":
            return f"file string, minimizer long, nonzero {b.NONZERO}"
        return f"file string, minimizer long, {'packed' if self.options['sparse'] == 'true' else 'color_words'} array<long>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def _load(spark: SparkSession, paths: list[str] | str, sparse: bool, n_words: int, layout: list, split: int | None, nonzero: bool = False) -> DataFrame:
    spark.dataSource.register(RawSource)
    options = {"files": json.dumps(storage.listing(spark, paths)), "sparse": str(sparse).lower(), "words": str(n_words), "layout": json.dumps(layout), "nonzero": str(nonzero).lower()}
    return spark.read.format("motifel_raw").options(**options, split=str(split or storage.split_bytes(spark))).load()


def read_raw(spark: SparkSession, paths: list[str] | str, n_colors: int = 0, split: int | None = None, nonzero: bool = False) -> DataFrame:
    """(file, minimizer, color_words) of dense files; without colors the words are empty. Files that do
    not hold whole rows are an error. split: bytes of a part, by default as in Spark's file sources. nonzero:
    (file, minimizer, nonzero) instead, so that Spark gets the words only that are not 0."""
    return _load(spark, paths, False, b.words_needed(n_colors) if n_colors else 0, [], split, nonzero)


def read_sparse(spark: SparkSession, paths: list[str] | str, n_colors: int, parts: tuple[int, int] | None = None) -> DataFrame:
    """(file, minimizer, colors) of sparse files."""
    layout = b.SparseLayout(n_colors, parts)
    rows = _load(spark, paths, True, 0, [n_colors, parts], None)
    return rows.select("file", "minimizer", b.sparse_unpack(F.col("packed"), layout).alias("colors"))


def interleaved(first: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Each number of first, and behind it those of its list."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    at = offsets[:-1] - offsets[0] + np.arange(len(first))
    out = np.empty(len(first) + len(values), values.dtype if len(values) else first.dtype)
    own = np.zeros(len(out), bool)
    own[at] = True
    out[own], out[~own] = first, values
    return out


def _as_words(batch: pa.RecordBatch) -> bytes:
    first = batch.column(0).to_numpy()
    if batch.num_columns == 1:
        return first.astype("<i8").tobytes()
    return interleaved(first, batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)).astype("<i8").tobytes()


def _as_dense(n_words: int):
    def encode(batch: pa.RecordBatch) -> bytes:
        """All words of rows (minimizer, nonzero)."""
        lists = batch.column(1)
        entries, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
        out = np.zeros((batch.num_rows, 1 + n_words), "<i8")
        out[:, 0] = batch.column(0).to_numpy()
        out[row, 1 + entries.field("i").to_numpy()] = entries.field("w").to_numpy()
        return out.tobytes()

    return encode


def _as_index(batch: pa.RecordBatch) -> bytes:
    """lo, hi, count and colors of each row as 32-bit words."""
    lo, hi, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
    lists = batch.column(3).cast(pa.list_(pa.int64()))
    head = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1) * 2, pa.int32()), pa.array(np.stack([hi, n], 1).ravel()))
    three = interleaved(lo, head).reshape(-1, 3)
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    out = np.empty(three.size + len(values), np.int64)
    own = np.zeros(len(out), bool)
    at = offsets[:-1] - offsets[0] + 3 * np.arange(len(lo))
    for i in range(3):
        own[at + i] = True
    out[own], out[~own] = three.ravel(), values
    return out.astype("<u4").tobytes()


def _write(folder: str, kind: str, codec: str, encode, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, path, n, out = context.partitionId(), "", 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{folder}/{part:05d}-{context.taskAttemptId()}"
                out = storage.open_out(path, codec)
            for i in range(0, batch.num_rows, most):
                out.write(encode(batch.slice(i, most)))
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([path]), pa.array([n])], ["part", "path", "n"])

    return run


def _write_parts(rows: DataFrame, path: str, kind: str, codec: str, encode, most: int = ROWS) -> int:
    """most: rows that are encoded at once."""
    spark = rows.sparkSession
    at = storage.qualified(spark, path)
    temporary = f"{at}/_temporary-{uuid.uuid4().hex}"
    try:
        done = rows.mapInArrow(_write(temporary, kind, codec, encode, most), "part long, path string, n long").collect()  # one small row for each part
        suffix = f".{kind}.{codec}" if codec else f".{kind}"
        spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at))
        storage.rename(spark, [(r["path"], f"{at}/part-{r['part']:05d}{suffix}") for r in done])
    finally:
        storage.delete(spark, temporary)
    return len(done)


def write_raw(rows: DataFrame, path: str, words: str | None = None, codec: str = "") -> int:
    """Writes the rows (sorted by the caller) as part files part-NNNNN.raw[.codec] of a folder, each by
    the task that has its rows; returns the number of parts. Parts of gzip, bzip2 and LZ4 frames
    may be put behind each other like plain ones. The folder must be one that all executors share."""
    return _write_parts(rows.select("minimizer", *([F.col(words).cast("array<long>").alias("words")] if words else [])), path, "raw", codec, _as_words)


def write_raw_nonzero(rows: DataFrame, path: str, n_colors: int, codec: str = "") -> int:
    """write_raw of rows (minimizer, nonzero): the files have all words, which the tasks that write them fill in."""
    n_words = b.words_needed(n_colors)
    return _write_parts(rows.select("minimizer", "nonzero"), path, "raw", codec, _as_dense(n_words), max(1, storage.BLOCK // (8 * (1 + n_words))))


def write_index(index: DataFrame, path: str, codec: str = "") -> int:
    """Writes rows (lo, hi, n_colors, colors) as a stream of 32-bit little-endian words: the halves of
    the minimizer, the count, the colors. Part files part-NNNNN.idx[.codec], as ``write_raw`` does."""
    return _write_parts(index.select("lo", "hi", F.col("n_colors").cast("long"), F.col("colors").cast("array<long>")), path, "idx", codec, _as_index)


def write_lines(rows: DataFrame, path: str, kind: str, codec: str = "") -> int:
    """Writes the text of the column ``value``, a line feed after each, as part files part-NNNNN.<kind>[.codec]."""
    return _write_parts(rows.select(F.col("value").cast("string")), path, kind, codec, _as_lines)


def _as_lines(batch: pa.RecordBatch) -> bytes:
    return b"".join(x + b"\n" for x in batch.column(0).cast(pa.binary()).to_pylist() if x is not None)


def write_hex(rows: DataFrame, path: str, codec: str | None = None) -> None:
    """One 16-digit hex number in each line, in the order of the rows."""
    writer = rows.select(b.hex16(F.col("minimizer")).alias("value")).write
    (writer.option("compression", codec) if codec else writer).text(path)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int | None, pa.Table]]:
    """(color, its other columns) of each run of rows of a color."""
    color, rest = batch.column("color"), pa.Table.from_batches([batch]).drop_columns(["color"])
    ids, null = color.fill_null(0).to_numpy(), color.is_null().to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
    for i, j in zip(starts, [*starts[1:], len(ids)], strict=True):
        yield (None if null[i] else int(ids[i])), rest.slice(i, j - i)


def _write_colors(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, n, last, out, names = context.partitionId(), 0, None, None, None
        fs, inside = storage.file_system(folder)

        def done() -> None:
            out.close()
            fs.move(*names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for color, rows in _runs(batch):
                if out is None or color != last:
                    if out is not None:
                        done()
                    at = f"{inside}/color={'__HIVE_DEFAULT_PARTITION__' if color is None else color}"
                    fs.create_dir(at, recursive=True)
                    names = f"{at}/.part-{part:05d}-{context.taskAttemptId()}", f"{at}/part-{part:05d}.parquet"
                    last, out = color, pq.ParquetWriter(names[0], rows.schema, filesystem=fs)
                    n += 1
                out.write_table(rows)
        if out is not None:
            done()
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return run


def write_by_color(pairs: DataFrame, path: str) -> int:
    """A folder color=<i> of Parquet files for each color, as partitionBy makes them; returns the number of
    files. Rows are dealt and sorted by color first, so a color is one file, or a few where it has more rows than
    a task should. A task writes under a hidden name and renames: one that runs twice leaves one file."""
    spark = pairs.sparkSession
    at = storage.qualified(spark, path)
    if storage.exists(spark, at):
        raise FileExistsError(at)
    dealt = pairs.hint("rebalance", "color").sortWithinPartitions("color")
    done = dealt.mapInArrow(_write_colors(at), "n long").collect()  # one small row for each task
    storage.make_folder(spark, at)
    return sum(r["n"] for r in done)
