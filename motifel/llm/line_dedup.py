"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines
over the threshold, and put the others together again by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The normalised line, or None if it has fewer than min_chars code points."""
    key = line.strip(common.WORD_SPACE).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and common.code_points(key) < min_chars:
        return None
    return key


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts = [], []
            for text in common.as_bytes(b.column("text")):
                keys = {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                hashes.extend(map(_hash, keys))
                counts.append(len(keys))
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            ids = np.repeat(b.column("doc_id").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(ids)], ["h1", "h2", "doc_id"])

    return run


def _reassemble(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, dropped = [], [], []
            for text, drops in zip(common.as_bytes(b.column("text")), b.column("drops").to_pylist(), strict=True):
                lines = text.split(b"\n")
                kept = lines
                if drops:
                    doomed = set(drops)
                    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _hash(k) not in doomed]
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            rest = [c for c in b.schema.names if c not in ("text", "drops")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), text, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], [*rest, "text", "n_lines", "n_dropped"])

    return run


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, drops array<binary>): of each document that loses lines, the hashes of those."""
    pairs = common.documents(docs).mapInArrow(common.tidy(_explode(min_chars)), "h1 long, h2 long, doc_id long")
    # (hash, document) pairs spread one hot line over all tasks; only then one row per hash and task moves.
    counted = pairs.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep"))
    # A written table, so that the join below starts from two plain exchanges and Spark can split the partition of a hot line.
    doomed = common.cut(counted.where(F.col("n_docs") >= min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keep"), "repeated-lines")
    lost = pairs.join(doomed, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(F.col("doc_id") != F.col("keep"))
    as_binary = F.expr("unhex(concat(lpad(hex(h1),16,'0'),lpad(hex(h2),16,'0')))")
    return lost.groupBy("doc_id").agg(F.collect_set(as_binary).alias("drops"))  # rows that share an id lose the same lines


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, text (what stays), n_lines (before), n_dropped.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
    lower-cased. A key of at least min_chars code points found in at least min_docs
    different doc_ids loses all its lines except in the largest doc_id that holds it
    (all rows of that doc_id keep them). Other lines stay in their order, joined by \\n.
    Null or empty text: one empty line. Null ids count as one document, below all others.
    Rows that repeat a doc_id are each handled with their own text. ``carry`` names further
    columns to hand through unchanged. An empty table gives an empty result.
    """
    base = common.documents(docs, *carry)
    if carry:
        base = base.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))
    drops = repeated_lines(docs, min_chars, min_docs).withColumnRenamed("doc_id", "drop_id")
    joined = base.join(drops, F.col("doc_id") == F.col("drop_id"), "left").drop("drop_id")
    kind = dict(joined.dtypes)
    schema = ", ".join([f"{c} {kind[c]}" for c in joined.columns if c not in ("text", "drops")] + ["text string", "n_lines long", "n_dropped long"])
    done = joined.mapInArrow(common.tidy(_reassemble(min_chars)), schema)
    return done.select(common.public_id("doc_id").alias("doc_id"), "text", "n_lines", "n_dropped", *([F.col("carried")[c].alias(c) for c in carry]))
