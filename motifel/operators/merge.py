"""Merging sets of window hashes, plain or colored.

Any number of inputs is one aggregation with partial merging in each task (``merge_n``); two
inputs whose colors stand behind each other are a full outer join (``merge_two_colored``). The
second form is for stored sets that are already bucketed by minimizer; otherwise prefer the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.operators.colors import as_nonzero, split_dense, split_sparse, with_words


def merge_plain(*sets: DataFrame) -> DataFrame:
    """(minimizer): the union of sets without colors."""
    return reduce(DataFrame.union, [s.select("minimizer") for s in sets]).distinct()


def color_single(plain: DataFrame) -> DataFrame:
    """(minimizer, color_words) of a set that is one color."""
    return plain.select("minimizer", F.array(F.lit(1).cast("long")).alias("color_words"))


def merge_n(*sets: DataFrame) -> DataFrame:
    """(minimizer, color): pairs of plain sets, in their order the colors 0, 1, ..."""
    return reduce(DataFrame.union, [s.select("minimizer", F.lit(i).alias("color")) for i, s in enumerate(sets)]).distinct()


def merge_two_colored(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> DataFrame:
    """(minimizer, color_words): the right set's colors follow the left's.

    Up to 64 colors together the right word is shifted by n_left and joined by OR; otherwise
    each side keeps its own words, missing ones 0, those of the left first.
    """
    zero = lambda n: F.array(*[F.lit(0).cast("long")] * n)
    a, c = b.words_needed(n_left), b.words_needed(n_right)
    both = left.select("minimizer", F.col("color_words").alias("wl")).join(right.select("minimizer", F.col("color_words").alias("wr")), "minimizer", "full_outer")
    wl, wr = F.coalesce("wl", zero(a)), F.coalesce("wr", zero(c))
    if n_left + n_right <= 64:
        return both.select("minimizer", F.array(wl[0].bitwiseOR(F.shiftleft(wr[0], n_left))).alias("color_words"))
    return both.select("minimizer", F.concat(wl, wr).alias("color_words"))


def merge_n_words(*sets: tuple[DataFrame, int]) -> DataFrame:
    """(minimizer, color_words) of any number of colored sets, each with its number of colors: the words
    of each behind those of the one before, zeros where a set has none. One aggregation; a
    minimizer gathers at most one row of each set."""
    zero = lambda n: F.array(*[F.lit(0).cast("long")] * n)
    rows = reduce(DataFrame.union, [s.select("minimizer", F.lit(i).alias("i"), "color_words") for i, (s, _) in enumerate(sets)])
    by = rows.groupBy("minimizer").agg(F.map_from_entries(F.collect_list(F.struct("i", "color_words"))).alias("by"))
    return by.select("minimizer", F.concat(*[F.coalesce(F.try_element_at("by", F.lit(i)), zero(b.words_needed(n))) for i, (_, n) in enumerate(sets)]).alias("color_words"))


def merge_final(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> tuple[DataFrame, DataFrame, b.SparseLayout]:
    """The merged set split into dense rows and sparse lists. The sets meet by their words that are not 0."""
    layout = b.SparseLayout(n_left + n_right, (n_left, n_right))
    if not layout.split:
        merged = merge_two_colored(*map(with_words, (left, right), (n_left, n_right)), n_left, n_right)
        return split_dense(merged, layout), split_sparse(merged, layout), layout
    l, r = (as_nonzero(s).select("minimizer", F.col("nonzero").alias(name)) for s, name in ((left, "wl"), (right, "wr")))  # noqa: E741
    none = F.array().cast(b.NONZERO)
    both = l.join(r, "minimizer", "full_outer").select("minimizer", F.coalesce("wl", none).alias("wl"), F.coalesce("wr", none).alias("wr"))
    n_set = b.nonzero_popcount(F.col("wl")) + b.nonzero_popcount(F.col("wr"))
    # Words of two inputs do not always lie as those of one: the right set's colors begin at a word of their own.
    all_words = F.concat(b.nonzero_words(F.col("wl"), b.words_needed(n_left)), b.nonzero_words(F.col("wr"), b.words_needed(n_right)))
    dense = both.where(n_set > layout.threshold).select("minimizer", all_words.alias("color_words"))
    right_ids = F.transform(b.nonzero_list(F.col("wr"), n_right), lambda c: (c + n_left).cast("int"))
    listed = both.where(n_set <= layout.threshold).select("minimizer", F.concat(b.nonzero_list(F.col("wl"), n_left), right_ids).alias("colors"))
    return dense, listed.withColumn("packed", b.sparse_pack(F.col("colors"), layout)), layout


def merge_report(*sets: DataFrame) -> DataFrame:
    """One row: n_start (all elements), n_skipped (met again), n_final."""
    all_rows = reduce(DataFrame.union, [s.select("minimizer") for s in sets])
    per = all_rows.groupBy("minimizer").agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_start"), F.count("*").alias("n_final"))
    return out.select("n_start", (F.col("n_start") - F.col("n_final")).alias("n_skipped"), "n_final")
