"""Colored sets: which of N sets hold a minimizer.

Two forms. Pairs: (minimizer, color), the form to join and group. Rows: (minimizer, color_words),
a bitmap of ceil(N / 64) words in which color c is bit c mod 64 of word c div 64; or (minimizer,
nonzero), the words of the bitmap that are not 0 with their places (bits.NONZERO), which with many colors
are far fewer; or (minimizer, colors), an ascending list. A color is the rank of its set in the sorted list of all sets, also of
those that hold nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifel.functions import bits as b

WIDE = 16
"""Up to so many words each is an aggregate of its own; beyond, words are rows first."""


def color_dimension(names: DataFrame, name: str = "file") -> DataFrame:
    """(color_id, file): ranks of the distinct names. A dimension table, of the size of the list of sets."""
    return names.select(F.col(name).alias("file")).distinct().select((F.row_number().over(Window.orderBy("file")) - 1).alias("color_id"), "file")


def small(dimension: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A dimension, marked to go to all executors if it has at most ``most`` rows; a larger one is joined by a shuffle."""
    return F.broadcast(dimension) if dimension.limit(most + 1).count() <= most else dimension


def color_count(pairs: DataFrame) -> int:
    """One more than the largest color."""
    return (pairs.agg(F.max("color")).first()[0] or 0) + 1


def color_bitmap(pairs: DataFrame) -> DataFrame:
    """(minimizer, w0) for at most 64 colors."""
    color = F.when(~F.col("color").between(0, 63), F.raise_error(F.lit("a color beyond 63 needs color_words"))).otherwise(F.col("color"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), color.cast("int"))
    return pairs.groupBy("minimizer").agg(F.bit_or(bit).alias("w0"))


def color_words(pairs: DataFrame, n_colors: int) -> DataFrame:
    """(minimizer, color_words): one shuffle, with the bits of a task merged before it."""
    n = b.words_needed(n_colors)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("color") % 64).cast("int"))
    word = F.floor(F.col("color") / 64)
    if n <= WIDE:
        each = [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(n)]
        return pairs.groupBy("minimizer").agg(*each).select("minimizer", F.array(*[f"w{i}" for i in range(n)]).alias("color_words"))
    return nonzero_rows(pairs).select("minimizer", b.nonzero_words(F.col("nonzero"), n).alias("color_words"))


def nonzero_rows(pairs: DataFrame) -> DataFrame:
    """(minimizer, nonzero) of pairs, which may repeat; of the size of the pairs, whatever the number of colors."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("color") % 64).cast("int"))
    rows = pairs.groupBy("minimizer", F.floor(F.col("color") / 64).cast("int").alias("i")).agg(F.bit_or(bit).alias("w"))
    entry = F.when(F.col("i").isNotNull(), F.struct("i", "w"))  # no entry of a null color
    return rows.groupBy("minimizer").agg(F.sort_array(F.collect_list(entry)).cast(b.NONZERO).alias("nonzero"))


def as_nonzero(rows: DataFrame) -> DataFrame:
    """rows with ``nonzero`` in the place of color_words."""
    if "nonzero" in rows.columns:
        return rows
    return rows.select(*[c for c in rows.columns if c != "color_words"], b.nonzero(F.col("color_words")).alias("nonzero"))


def color_lists(pairs: DataFrame) -> DataFrame:
    """(minimizer, colors): ascending ids."""
    return pairs.groupBy("minimizer").agg(F.array_sort(F.collect_set(F.col("color").cast("int"))).alias("colors"))


def with_words(rows: DataFrame, n_colors: int) -> DataFrame:
    """rows with ``color_words`` in the place of nonzero."""
    if "color_words" in rows.columns:
        return rows
    words = b.nonzero_words(F.col("nonzero"), b.words_needed(n_colors)).alias("color_words")
    return rows.select(*[c for c in rows.columns if c != "nonzero"], words)


def as_pairs(rows: DataFrame, n_colors: int) -> DataFrame:
    """(color, minimizer) for each bit that is set: the set of each color, behind each other."""
    return as_nonzero(rows).select(F.explode(b.nonzero_list(F.col("nonzero"), n_colors)).alias("color"), "minimizer")


def extract_color(rows: DataFrame, color: int, n_colors: int) -> DataFrame:
    """(minimizer) of one color."""
    if not 0 <= color < n_colors:
        raise ValueError(f"color {color} is not among {n_colors}")
    return rows.where(b.has_color(F.col("color_words"), color)).select("minimizer")


def color_index(rows: DataFrame, n_colors: int) -> DataFrame:
    """(lo, hi, n_colors, colors): halves of the minimizer and its list."""
    listed = b.to_list(F.col("color_words"), n_colors)
    return rows.select(b.low32(F.col("minimizer")).alias("lo"), b.high32(F.col("minimizer")).alias("hi"), F.size(listed).alias("n_colors"), listed.alias("colors"))


def split_dense(rows: DataFrame, layout: b.SparseLayout) -> DataFrame:
    """The rows with more colors than a list is good for; all rows where there is no split."""
    return rows.where(b.popcount(F.col("color_words")) > layout.threshold) if layout.split else rows


def split_sparse(rows: DataFrame, layout: b.SparseLayout) -> DataFrame:
    """(minimizer, colors, packed) of the other rows."""
    few = rows.where(b.popcount(F.col("color_words")) <= layout.threshold) if layout.split else rows.where(F.lit(False))
    listed = few.select("minimizer", b.to_list(F.col("color_words"), layout.n_colors).alias("colors"))
    return listed.withColumn("packed", b.sparse_pack(F.col("colors"), layout))


def raw_dump(rows: DataFrame, n_colors: int, *more: str) -> DataFrame:
    """(minimizer, hex, words, colors, *more) as text, for people. The text of the words is longer than all else:
    rows are best numbered or sorted before."""
    w = F.col("nonzero")
    listed = F.array_join(b.nonzero_list(w, n_colors).cast("array<string>"), " ").alias("colors")
    return as_nonzero(rows).select("minimizer", b.hex16(F.col("minimizer")).alias("hex"), b.nonzero_hex(w, b.words_needed(n_colors)).alias("words"), listed, *more)


def _mask_words(colors: list[int], n_colors: int) -> list[int]:
    words = [0] * b.words_needed(n_colors)
    for c in colors:
        words[c // 64] |= 1 << (c % 64)
    return words


def _meets(words: Column, mask: list[int], test) -> Column:
    return reduce(lambda x, y: x & y, [test(F.element_at(words, i + 1).bitwiseAND(b.bits(m)), b.bits(m)) for i, m in enumerate(mask) if m], F.lit(True))


def ext_intersect(rows: DataFrame, colors: list[int], n_colors: int) -> DataFrame:
    """Extension: window hashes that all of the colors have."""
    return rows.where(_meets(F.col("color_words"), _mask_words(colors, n_colors), lambda x, m: x == m)).select("minimizer")


def ext_except(rows: DataFrame, of: list[int], without: list[int], n_colors: int) -> DataFrame:
    """Extension: window hashes that all of some colors and none of the others have."""
    has = _meets(F.col("color_words"), _mask_words(of, n_colors), lambda x, m: x == m)
    free = _meets(F.col("color_words"), _mask_words(without, n_colors), lambda x, m: x == 0)
    return rows.where(has & free).select("minimizer")


def ext_jaccard(pairs: DataFrame, n_colors: int) -> DataFrame:
    """Extension: (a, b, n_both, jaccard) of each two colors that share a minimizer. From the color
    sets: those of equal window hashes are counted first, so a set gives its pairs once. The pairs of
    colors are the result, so it grows with their square; their number must be one that allows that."""
    sets = color_lists(pairs).groupBy("colors").agg(F.count("*").alias("n"))
    both = sets.select(F.explode("colors").alias("a"), "colors", "n").select("a", F.explode(F.filter("colors", lambda c: c > F.col("a"))).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    size = sets.select(F.explode("colors").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("size"))
    sized = both.join(size.select(F.col("c").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("size").alias("nb")), "b")
    return sized.select("a", "b", "n_both", (F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard"))
