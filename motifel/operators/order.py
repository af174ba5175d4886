"""Orders of colored sets, ordinals, checks and comparisons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.sources.scratch import shared_path


def _key(some: Column, word: Callable[[Column], Column], last: Column) -> Column:
    """Bytes that sort as all words do, by number, then last. Of the first words that differ the one
    at an earlier place is against a 0, so it is the greater: places count down, and 0, which is none, ends them."""
    entry = lambda e: F.concat(F.lpad(F.hex(F.lit(b.LOW) - e["i"]), 8, "0"), b.hex16(word(e["w"])))
    return F.unhex(F.concat(F.array_join(F.transform(some, entry), ""), F.lit("0" * 8), b.hex16(last)))


def dense_key(words: Column, minimizer: Column) -> Column:
    """Bytes that sort as dense rows do: color words by their bytes in memory, lowest byte first, then the
    minimizer. As long as the words that are not 0."""
    return dense_key_of(b.nonzero(words), minimizer)


def dense_key_of(some: Column, minimizer: Column) -> Column:
    """dense_key of words by bits.NONZERO."""
    return _key(some, b.byte_swapped, minimizer)


def numeric_key(words: Column, minimizer: Column) -> Column:
    """Bytes that sort by the words as unsigned numbers, then the minimizer."""
    return numeric_key_of(b.nonzero(words), minimizer)


def numeric_key_of(some: Column, last: Column) -> Column:
    """numeric_key of words by bits.NONZERO."""
    return _key(some, lambda w: w, last)


def sparse_key(colors: Column, minimizer: Column) -> Column:
    """Bytes that sort by count, then ids, then minimizer: the order of packed words."""
    return F.unhex(F.concat(F.lpad(F.hex(F.size(colors)), 8, "0"), F.array_join(F.transform(colors, lambda c: F.lpad(F.hex(c), 8, "0")), ""), b.hex16(minimizer)))


def sort_dense(rows: DataFrame) -> DataFrame:
    some = F.col("nonzero") if "nonzero" in rows.columns else b.nonzero(F.col("color_words"))
    return rows.orderBy(dense_key_of(some, F.col("minimizer")))


def sort_sparse(lists: DataFrame) -> DataFrame:
    return lists.orderBy(F.size("colors"), "colors", b.unsigned_key(F.col("minimizer")))


_LOCAL = (1 << 33) - 1
"""The part of a monotonically increasing id that counts inside a partition."""


def ordinal(rows: DataFrame, key: Column, out: str = "idx") -> DataFrame:
    """rows with their number from 0 in the order of key (different for each row).

    The rows are range-partitioned by the key, sorted, and written once with their place in their
    partition; the sizes of the partitions before it are added when they are read. No task sees
    more than a partition, and there are as many of those as in any sort of the session.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("__key", key).repartitionByRange("__key").sortWithinPartitions("__key").drop("__key").withColumn("__at", F.monotonically_increasing_id())
    path = shared_path(spark, "ordinal")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright("__at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, before = [], 0
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    start = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    return placed.join(start, part == F.col("__part")).select(*rows.columns, (F.col("__start") + F.col("__at").bitwiseAND(F.lit(_LOCAL))).alias(out))


def color_sorter(rows: DataFrame) -> DataFrame:
    """(idx, ordinal, color_words, or nonzero where rows have that): rows by their words as numbers, equal ones
    by falling ordinal; the ordinal, a row's number in the order of window hashes, stands for the minimizer."""
    words = "nonzero" if "nonzero" in rows.columns else "color_words"
    some = F.col(words) if words == "nonzero" else b.nonzero(F.col(words))
    named = ordinal(rows, b.hex16(F.col("minimizer")), "ordinal")
    return ordinal(named, numeric_key_of(some, F.lit(-1).cast("long") - F.col("ordinal"))).select("idx", "ordinal", words)


def color_top(lists: DataFrame, n: int = 16, smallest: bool = True) -> DataFrame:
    """The first (or last) n rows in the order of sparse sets: a top-k, no full sort."""
    way = (lambda c: c.asc()) if smallest else (lambda c: c.desc())
    return lists.orderBy(way(F.size("colors")), way(F.col("colors")), way(b.unsigned_key(F.col("minimizer")))).limit(n)


def _falls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its rows, its places where the key falls, its first and last key."""
    n, falls, first, last = 0, 0, None, None
    for batch in batches:
        keys = batch.column("k")
        if not len(keys):
            continue
        if first is None:
            first = keys.slice(0, 1)
        else:
            keys = pa.concat_arrays([last, keys])
        falls += pc.sum(pc.less(keys.slice(1), keys.slice(0, len(keys) - 1))).as_py() or 0
        n += batch.num_rows
        last = keys.slice(len(keys) - 1)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([falls]), first, last], ["n", "falls", "first", "last"])


def check_sorted(rows: DataFrame, key: Column, idx: str | None = None) -> DataFrame:
    """One row: n_rows, n_violations (rows whose key is below that of the row before). The order is that
    of ``idx``, or without it that of the rows as they are read, partition by partition. A partition
    is one pass; then the last key of each meets the first of the next."""
    base = rows.select(key.alias("k"), *([F.col(idx).alias("i")] if idx else []))
    if idx:
        base = base.repartitionByRange("i").sortWithinPartitions("i").select("k")
    kind = base.schema["k"].dataType.simpleString()
    parts = base.mapInArrow(_falls, f"n long, falls long, first {kind}, last {kind}").withColumn("p", F.monotonically_increasing_id())
    across = parts.withColumn("before", F.lag("last").over(Window.orderBy("p")))  # a row for each partition
    border = F.when(F.col("first") < F.col("before"), 1).otherwise(0)
    zero = F.lit(0).cast("long")
    return across.agg(F.coalesce(F.sum("n"), zero).alias("n_rows"), F.coalesce(F.sum(F.col("falls") + border), zero).cast("long").alias("n_violations"))


def raw_compare(left: DataFrame, right: DataFrame, value: str = "minimizer", around: int = 16, idx: str = "idx") -> DataFrame:
    """(idx, a, b, same) around the first place where two numbered sets differ, over the length of the
    shorter; no rows if they agree."""
    both = left.select(idx, F.col(value).alias("a")).join(right.select(idx, F.col(value).alias("b")), idx)
    first = both.where("a <> b").agg(F.min(idx).alias("first"))
    near = both.join(F.broadcast(first), F.col(idx).between(F.col("first") - around, F.col("first") + around - 1))  # one row
    return near.select(idx, "a", "b", (F.col("a") == F.col("b")).alias("same"))
