"""The queries of the training-data operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifel.llm.exact_dedup import exact_dedup
from motifel.llm.fingerprint import fingerprints
from motifel.llm.html_extract import extract_main_text
from motifel.llm.line_dedup import line_dedup
from motifel.llm.mixing import mix
from motifel.llm.ngram_join import ngram_groups
from motifel.llm.packing import pack
from motifel.llm.pii import surrogate_text
from motifel.llm.quality import classify
from motifel.llm.token_counts import token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a key of its own that protects nothing; a real run takes one from its secrets."""
    return surrogate_text(_documents(spark, sf_dir), b"a key for tests and examples only")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_documents(spark, sf_dir), min_chars=20, min_docs=3)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(_documents(spark, sf_dir), n=5, threshold=(75, 100))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of the fields source and text; sentences of the text are sections."""
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), fields=("source", "text"), split=("text",))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), keep="largest")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_document_fingerprints, op3_source_mixing, op4_pii_surrogates, op5_line_dedup, op6_ngram_jaccard_join, op7_best_fit_packing, op8_quality_classifier, op9_token_counts, op10_exact_dedup)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op6_ngram_jaccard_join": rf"""
        WITH RECURSIVE low AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        gram AS (
          SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
          FROM low),
        size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
        shared AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
          FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (
          SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
          WHERE 100 * c >= 75 * (x.n + y.n - c)),
        way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT a AS v, b AS r FROM way UNION SELECT reach.v, way.b FROM reach JOIN way ON reach.r = way.a),
        least_of AS (SELECT v, min(r) AS least FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(l.least, d.doc_id)) AS component_id
        FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN least_of l ON l.v = d.doc_id""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_line_dedup": """
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
          FROM documents),
        keyed AS (
          SELECT doc_id, line, pos,
                 translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM lines),
        common AS (
          SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT k.doc_id, count(*) AS n_lines,
               count(*) FILTER (WHERE c.key IS NOT NULL AND c.keep <> k.doc_id) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
                      FILTER (WHERE c.key IS NULL OR c.keep = k.doc_id), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id""",
}
