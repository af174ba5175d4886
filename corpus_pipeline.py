"""Documents to training sequences: quality, repeated lines, near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifel.llm import common
from motifel.llm.line_dedup import line_dedup
from motifel.llm.mixing import mix
from motifel.llm.ngram_join import ngram_groups
from motifel.llm.packing import pack
from motifel.llm.quality import classify

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives label 1, at the threshold of its query. Null and empty texts
    are scored as texts without words, and repeated rows alike; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, labels, threshold=0.3, carry=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 1").select(COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that many of them share; n_chars follows the text. A null text
    becomes the empty one; a document that loses all its lines stays, empty."""
    done = line_dedup(docs, min_chars=20, min_docs=3, carry=("lang", "source"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id. A doc_id of several
    rows goes only if all of them are linked to a smaller one."""
    groups = ngram_groups(docs, n=5, threshold=(75, 100))
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("not stays").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, rows that repeat a doc_id each by their own number. A
    null source is a source of its own; texts without words stay once."""
    taken = mix(docs, carry=("text", "lang", "n_chars")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies and their places in sequences. An empty text is its end id alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None
"""SQL expresses neither the classifier nor the packing; the tests hold each stage against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over the written result of the one before; tables that only earlier ones read are deleted as soon as theirs is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = common.written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.cut(docs, f"stage-{name}")
            common.release(spark, mark, keep=1)
    return docs
