"""The whole index: files or records to dense and sparse colored sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifel.functions import bits as b
from motifel.operators import colors, extract
from motifel.sources import fastx


@dataclass
class Index:
    """pairs: (minimizer, color); dense: (minimizer, color_words); sparse: (minimizer, colors, packed); files: (color_id, file)."""

    pairs: DataFrame
    dense: DataFrame
    sparse: DataFrame
    files: DataFrame
    n_colors: int
    layout: b.SparseLayout

    def rows(self) -> DataFrame:
        """All window hashes as bitmap rows."""
        return colors.color_words(self.pairs, self.n_colors)


def index_records(records: DataFrame, files: DataFrame, n_colors: int, k: int = extract.K, m: int = extract.M) -> Index:
    """Index of (color, seq) records; the color is set before anything is dealt out anew."""
    pairs = extract.minimizer_hashes(records, ["color"], k, m).select("minimizer", "color")
    layout = b.SparseLayout(n_colors)
    rows = colors.color_words(pairs, n_colors)
    return Index(pairs, colors.split_dense(rows, layout), colors.split_sparse(rows, layout), files, n_colors, layout)


def build_index(spark: SparkSession, paths: list[str], k: int = extract.K, m: int = extract.M) -> Index:
    """Index of sequence files, colors in the order of the list, files without window hashes included."""
    extract.check_sizes(k, m)
    name = lambda p: p.split(":", 1)[-1].lstrip("/")  # noqa: E731  file:/x, file:///x and /x are one file
    files = spark.createDataFrame([(i, p, name(p)) for i, p in enumerate(paths)], "color_id int, file string, name string")  # the list itself
    read = fastx.read_fastx(spark, paths, overlap=k - 1).withColumn("name", F.regexp_replace("file", "^[a-z0-9]*:/*|^/+", ""))
    records = read.join(colors.small(files.select("name", F.col("color_id").alias("color"))), "name").select("color", "seq")
    windows = extract.split_windows(records, k).select("color", "seq")
    return index_records(windows, files.select("color_id", "file"), len(paths), k, m)
