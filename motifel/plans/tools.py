"""The single tools as commands: ``python -m motifel.plans.tools COMMAND ...``.

Sets are folders or files of flat 64-bit words (plain, gz, bz2 or lz4 by name) or, with a name that
ends in .parquet, tables with the columns of their kind. The number of colors (-c) is a file's
layout; 0 means no colors.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.functions import dna
from motifel.operators import colors, extract, merge, order, stats
from motifel.sources import fastx, rawmini, storage
from motifel.sources.generated import generated_sets


def load(spark: SparkSession, path: str, n_colors: int) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    rows = rawmini.read_raw(spark, path, n_colors)
    return rows.drop("file") if n_colors else rows.select("minimizer")


def store(rows: DataFrame, path: str, words: str | None) -> None:
    """Sorted by minimizer, in the form that the name asks for."""
    ordered = extract.sorted_unsigned(rows, "minimizer")
    if path.endswith(".parquet"):
        ordered.write.parquet(path)
    else:
        codec = path.rsplit(".", 1)[-1]
        rawmini.write_raw(ordered, path, words, codec if codec in fastx.CODECS else "")


def _minimizer_set(spark, a):
    """With --save-debug also the hashes as they are before any sort, without repeats in a row, beside the output."""
    records = fastx.read_fastx(spark, a.input, overlap=a.kmer - 1)
    if a.save_debug:
        rawmini.write_raw(extract.placed_hashes(records, [], a.kmer, a.minimizer, runs=True), f"{a.output}.unsorted")
    found = extract.minimizer_hashes(records, [], a.kmer, a.minimizer)
    if not a.do_not_save_output:
        store(found, a.output, None)
    return found


def _kmers(spark, a):
    records = fastx.read_fastx(spark, a.input)
    counts = extract.kmer_counts(extract.kmers(records, [], a.kmer))
    if a.output:
        store(counts.withColumnRenamed("kmer", "minimizer"), a.output, None)
    return extract.kmer_stats(records, a.kmer)


def _merge(spark, a):
    left, right = load(spark, a.first, a.first_colors), load(spark, a.second, a.second_colors)
    if not a.first_colors and not a.second_colors:
        out, words = merge.merge_plain(left, right), None
    else:
        left, right = (x if n else merge.color_single(x) for x, n in ((left, a.first_colors), (right, a.second_colors)))
        out, words = merge.merge_two_colored(left, right, max(1, a.first_colors), max(1, a.second_colors)), "color_words"
    store(out, a.output, words)
    return merge.merge_report(left, right)


def _merge_all(spark, a):
    sets = [load(spark, p, 0) for p in a.input]
    if a.colored:
        out, words = colors.color_words(merge.merge_n(*sets), len(sets)), "color_words"
    else:
        out, words = merge.merge_plain(*sets), None
    store(out, a.output, words)
    return merge.merge_report(*sets)


def _stats(spark, a):
    return stats.color_histogram(load(spark, a.file, a.colors)).orderBy("n_colors")


def _sort(spark, a):
    done = order.color_sorter(load(spark, a.file, a.colors))
    done.orderBy("idx").write.parquet(a.output)
    return done


def _top(spark, a):
    rows = load(spark, a.file, a.colors)
    lists = rows.select("minimizer", b.to_list(F.col("color_words"), a.colors).alias("colors"))
    ends = [order.color_top(lists, a.rows, first) for first in (True, False)]
    return reduce(DataFrame.union, ends).select(b.hex16(F.col("minimizer")).alias("minimizer"), F.size("colors").alias("n_colors"), "colors")


def _extract(spark, a):
    one = colors.extract_color(load(spark, a.file, a.colors), a.select, a.colors)
    store(one, a.output, None)
    return one.agg(F.count("*").alias("n_keys"))


def _extract_all(spark, a):
    pairs = colors.as_pairs(load(spark, a.file, a.colors), a.colors)
    rawmini.write_by_color(pairs, a.output)
    return pairs.groupBy("color").agg(F.count("*").alias("n_keys")).orderBy("color")


def _index(spark, a):
    index = colors.color_index(load(spark, a.file, a.colors), a.colors)
    if a.output:
        codec = a.output.rsplit(".", 1)[-1]
        rawmini.write_index(index, a.output, codec if codec in fastx.CODECS else "")
    return index


def _line_count(spark, a):
    return storage.line_counts(spark, a.input)


def _value_length(spark, a):
    return stats.first_value_length(spark.read.text(a.file))


def _totals(spark, a):
    return stats.file_totals(spark.createDataFrame([(n,) for _, n in storage.listing(spark, a.input)], "length long"))


def _dump(spark, a):
    rows = load(spark, a.file, a.colors)
    if not a.colors:
        return order.ordinal(rows.select(b.hex16(F.col("minimizer")).alias("hex")), F.col("hex")).orderBy("idx")
    return order.ordinal(colors.raw_dump(rows, a.colors).drop("minimizer"), F.col("hex")).orderBy("idx")


def _compare(spark, a):
    numbered = (order.ordinal(load(spark, p, 0), b.hex16(F.col("minimizer"))) for p in (a.first, a.second))
    return order.raw_compare(*numbered).select("idx", b.hex16(F.col("a")).alias("a"), b.hex16(F.col("b")).alias("b"), "same").orderBy("idx")


def _check(spark, a):
    """In the order of the file: dense rows by their words, sparse ones by count, ids and minimizer, plain ones by value."""
    if a.sparse:
        rows = rawmini.read_sparse(spark, a.file, a.colors)
        return order.check_sorted(rows, order.sparse_key(F.col("colors"), F.col("minimizer")))
    rows = load(spark, a.file, a.colors)
    return order.check_sorted(rows, order.dense_key(F.col("color_words"), F.col("minimizer")) if a.colors else b.unsigned_key(F.col("minimizer")))


def _generate(spark, a):
    sets = generated_sets(spark, a.sets)
    for i in range(a.sets):
        store(sets.where(F.col("color") == i).select("minimizer").coalesce(1), f"{a.output}/testf_{i:03d}.raw", None)
    return sets.groupBy("color").agg(F.count("*").alias("n")).orderBy("color")


def _encode(spark, a):
    return spark.range(1).select(F.lit(a.text).alias("kmer"), dna.encode(F.lit(a.text), len(a.text)).alias("code"), dna.revcomp(F.lit(a.text)).alias("revcomp"))


_FILE = [(("-f", "--file"), {"required": True}), (("-c", "--colors"), {"type": int, "default": 0})]
_TWO = [(("first",), {}), (("second",), {})]
_OUT = (("-o", "--output"), {"required": True})
COMMANDS = {
    "minimizer-set": (_minimizer_set, [(("-i", "--input"), {"nargs": "+", "required": True}), _OUT, (("-k", "--kmer"), {"type": int, "default": 31}), (("-m", "--minimizer"), {"type": int, "default": 19}), (("--save-debug",), {"action": "store_true"}), (("--do-not-save-output",), {"action": "store_true"})]),
    "kmers": (_kmers, [(("-i", "--input"), {"nargs": "+", "required": True}), (("-o", "--output"), {}), (("-k", "--kmer"), {"type": int, "default": 27})]),
    "merge": (_merge, [*_TWO, _OUT, (("-c", "--first-colors"), {"type": int, "default": 0}), (("-C", "--second-colors"), {"type": int, "default": 0})]),
    "merge-all": (_merge_all, [(("-i", "--input"), {"nargs": "+", "required": True}), _OUT, (("--colored",), {"action": "store_true"})]),
    "color-stats": (_stats, _FILE),
    "color-sort": (_sort, [*_FILE, _OUT]),
    "color-top": (_top, [*_FILE, (("-m", "--rows"), {"type": int, "default": 16})]),
    "extract-color": (_extract, [*_FILE, _OUT, (("-s", "--select"), {"type": int, "required": True})]),
    "extract-all-colors": (_extract_all, [*_FILE, _OUT]),
    "extract-index": (_index, [*_FILE, (("-o", "--output"), {})]),
    "line-count": (_line_count, [(("-i", "--input"), {"nargs": "+", "required": True})]),
    "value-length": (_value_length, [(("-f", "--file"), {"required": True})]),
    "totals": (_totals, [(("-i", "--input"), {"nargs": "+", "required": True})]),
    "dump": (_dump, _FILE),
    "compare": (_compare, _TWO),
    "check-sorted": (_check, [*_FILE, (("--sparse",), {"action": "store_true"})]),
    "generate": (_generate, [_OUT, (("-n", "--sets"), {"type": int, "default": 16})]),
    "encode": (_encode, [(("text",), {})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    top = argparse.ArgumentParser(prog="motifel.tools")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        p = sub.add_parser(name)
        for flags, how in arguments:
            p.add_argument(*flags, **how)
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("motifel").getOrCreate()
    return COMMANDS[a.command][0](spark, a)


if __name__ == "__main__":
    main().show(1000, truncate=False)
