"""What the training-data operators share: internal ids, shared storage, Arrow access.

Conventions that hold in every operator of this subpackage:

* An operator reads only the columns that it names and carries them under its own
  names, so extra columns of the caller, whatever they are called, cannot clash.
* A null id is carried as the smallest 64-bit integer and turned back into null on
  output; so null ids count as one id below all others.
* A null text counts as the empty text.
"""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(1 << 63)
WORD_SPACE = b" \t\n\x0b\x0c\r"
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def internal_id(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def public_id(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def documents(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, *more) of docs; doc_id without nulls, see NULL_ID."""
    bound_batches(docs.sparkSession)
    return docs.select(internal_id(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by rows and bytes, so that a run of long texts stays small in a worker. A setting of the
    session: plans are made when a result is read, so it stays, and later queries of the session have
    batches of this size too (their results do not depend on it)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a temporary folder of
    this machine does in local mode (tests); elsewhere it would lose rows, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="motifel-shared-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: later jobs start from those
    files, whichever executors are lost meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def written() -> int:
    """How many tables ``cut`` has written so far, as a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that this process wrote by ``cut`` after a mark, but for the last ``keep``: for when all
    results that read them are stored. Returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for p in gone:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; nulls are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def give_back() -> None:
    """Freed memory to the operating system: a worker stays for later tasks, of other operators too."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, giving memory back when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
