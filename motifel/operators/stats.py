"""Reports about colored sets and inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifel.functions import bits as b


def color_histogram(rows: DataFrame) -> DataFrame:
    """(n_colors, occurrences, percent, cumulative): how many window hashes have how many colors. As many rows as colors at most."""
    per = rows.groupBy(b.popcount(F.col("color_words")).alias("n_colors")).agg(F.count("*").alias("occurrences"))
    # The sum over at most N + 1 rows; the running one in the order of color counts.
    total = F.sum("occurrences").over(Window.partitionBy())
    running = F.sum("occurrences").over(Window.orderBy("n_colors"))
    return per.select("n_colors", "occurrences", (F.lit(100.0) * F.col("occurrences") / total).alias("percent"), (F.lit(100.0) * running / total).alias("cumulative"))


def color_summary(rows: DataFrame, n_colors: int) -> DataFrame:
    """One row: n_keys, n_words (of the whole set), n_pairs, mean_colors, file_bytes, ram_bytes (a
    minimizer, a pointer, a count and two bytes for each color)."""
    width = 1 + b.words_needed(n_colors)
    base = rows.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(b.popcount(F.col("color_words"))), F.lit(0)).alias("n_pairs"))
    n = F.col("n_keys")
    return base.select("n_keys", (n * width).alias("n_words"), "n_pairs", (F.col("n_pairs") / n).alias("mean_colors"), (n * width * 8).alias("file_bytes"), (n * 24 + F.col("n_pairs") * 2).alias("ram_bytes"))


def line_count(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row: n_lines. Over rows of whole records, line feeds count; over rows of lines, rows do."""
    return texts.agg(F.coalesce(F.sum(F.length(column) - F.length(F.translate(column, "\n", ""))), F.lit(0)).alias("n_lines"))


def first_value_length(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: k, the length of the first line up to a tab."""
    return lines.limit(1).select(F.length(F.split(column, "\t")[0]).alias("k"))


def file_totals(files: DataFrame) -> DataFrame:
    """One row: n_files, n_bytes, n_kbytes, n_mbytes of a listing with a column ``length``."""
    n = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(F.count("*").alias("n_files"), n.alias("n_bytes"), F.floor(n / 1024).alias("n_kbytes"), F.floor(n / 1024 / 1024).alias("n_mbytes"))
