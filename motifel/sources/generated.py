"""Generated sets to try merges on: set v holds 0 and v in each byte of a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generated_sets(spark: SparkSession, n: int) -> DataFrame:
    """(color, minimizer) of the sets 0 to n - 1, distinct and in the order of colors."""
    bytes_of = [F.shiftleft(F.col("id"), 8 * i) for i in range(8)]
    return spark.range(n).select(F.col("id").cast("int").alias("color"), F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), *bytes_of))).alias("minimizer"))
