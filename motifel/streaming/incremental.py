"""Growing an index from a stream of records (an extension: file sources to colored pairs).

Each micro-batch turns into distinct (minimizer, color) pairs and goes to a folder named by its
batch id, replacing what an earlier try of the same batch left; so a batch that is run again
changes nothing. Readers take the distinct pairs of all folders; ``compact`` rewrites them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from motifel.operators import colors, extract


def update_index(records: DataFrame, path: str, checkpoint: str, k: int = extract.K, m: int = extract.M, once: bool = True) -> StreamingQuery:
    """Starts the query over a streaming DataFrame (color, seq)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        pairs = extract.minimizer_hashes(batch, ["color"], k, m).select("minimizer", "color")
        pairs.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """The distinct pairs so far."""
    return spark.read.parquet(path).select("minimizer", "color").distinct()


def rows(spark: SparkSession, path: str, n_colors: int) -> DataFrame:
    return colors.color_words(pairs(spark, path), n_colors)


def compact(spark: SparkSession, path: str, to: str) -> None:
    pairs(spark, path).write.parquet(to)
