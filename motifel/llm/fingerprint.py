"""Document fingerprints of closed syncmers.

A closed syncmer is a k-mer whose smallest inner s-mer (by hash) stands at its first or last
place. Whether a k-mer is one depends on its own bytes only, so a passage keeps its anchors
whatever stands before or after it. k-mers and s-mers are runs of UTF-8 bytes. All k-mers of
the whole text are looked at; the fingerprint keeps all syncmers, in the order in which they
stand in the text, so that two fingerprints can be matched by position: their likeness is the
longest chain of common anchors that has the same order in both texts, over all anchors of both
together. A fingerprint so has about as many characters as its text has bytes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common

S, K = 8, 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def syncmers(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all closed syncmers and the hashes (32 bits) of their k-mers. A text of
    fewer than K bytes is one anchor itself; an empty one has none."""
    n = len(text)
    if n < K:
        return np.zeros(min(n, 1), np.int64), np.array([xxhash.xxh3_64_intdigest(text) >> 32][: min(n, 1)], np.uint32)
    m = n - S + 1
    word = np.empty(m, np.uint64)  # the s-mer at each byte
    for j in range(min(S, m)):
        word[j::S] = np.frombuffer(text, "<u8", (n - j) // S, j)
    h = _mix(word)
    low = np.minimum(h[:-1], h[1:])
    for step in (2, 4, 8):
        low = np.minimum(low[:-step], low[step:])  # in the end of 16 s-mers
    edge = np.minimum(h[: m - 16], h[16:])
    at = np.flatnonzero(edge <= low[: m - 16])
    kmer = _mix(_mix(h[at] + word[at + 8]) + word[at + 16])
    return at, (kmer >> np.uint64(32)).astype(np.uint32)


def sketch(text: bytes) -> np.ndarray:
    """The anchors, each once, in the order of their first places."""
    _, hashes = syncmers(text)
    values, first = np.unique(hashes, return_index=True)
    return values[np.argsort(first)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints, two empty ones included."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    _, left, right = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = len(a) + len(b) - len(left)
    places = right[np.argsort(left)]  # in b, of the common anchors in the order of a
    if (places[1:] > places[:-1]).all():
        return len(places) / both
    chain: list[int] = []  # of a longest rising run of places, the smallest ends
    for i in places.tolist():
        if not chain or i > chain[-1]:
            chain.append(i)
        else:
            chain[bisect.bisect_left(chain, i)] = i
    return len(chain) / both


def hexed(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of the text, and the text with its last quarter (floor) replaced by as much of the beginning of the next."""
    if text.isascii() and following.isascii():
        q = len(text) // 4
        return len(text), text[: len(text) - q] + following[:q]
    t, f = text.decode("utf-8", "surrogateescape"), following.decode("utf-8", "surrogateescape")
    q = len(t) // 4
    return len(t), (t[: len(t) - q] + f[:q]).encode("utf-8", "surrogateescape")


def _deal(bounds: np.ndarray, firsts: dict[int, int]):
    """Rows to their bucket; the first document of a bucket also to the end of the bucket before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            bucket = np.searchsorted(bounds, ids, "right").astype(np.int32)
            copies = [i for i, x in enumerate(ids.tolist()) if x in firsts]
            take = pa.array(np.concatenate([np.arange(len(ids)), np.array(copies, np.int64)]))
            where = np.concatenate([bucket, np.array([firsts[int(ids[i])] for i in copies], np.int32)])
            border = np.zeros(len(where), np.int32)
            border[len(ids) :] = 1
            out = b.take(take)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(border), out.column("doc_id"), out.column("text")], ["bucket", "border", "doc_id", "text"])

    return run


def _least(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            buckets = np.searchsorted(bounds, ids, "right")
            found = {}
            for k, x in zip(buckets.tolist(), ids.tolist(), strict=True):
                found[k] = min(x, found.get(k, x))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["bucket", "least"])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the documents of a bucket in order: one document and its fingerprint are held at a time."""
    held = None
    for b in batches:
        rows = []
        for border, doc_id, text in zip(b.column("border").to_pylist(), b.column("doc_id").to_pylist(), common.as_bytes(b.column("text")), strict=True):
            if border and held is None:
                continue
            own = sketch(text)
            if held is not None:
                before, before_id, before_own = held
                n, changed = edited(before, text)
                after = before_own if changed == before else sketch(changed)
                rows.append((before_id, n, hashlib.sha256(changed).hexdigest(), hexed(before_own), hexed(after), likeness(before_own, after), likeness(before_own, own)))
            held = None if border else (text, doc_id, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by ascending doc_id, after the last the first; rows that
    repeat an id follow each other by a hash of their text. A null id comes first, a null text
    is empty. One row alone is its own next. fingerprint: 8 hex digits for each anchor, empty
    for the empty text; equal texts have equal ones. An empty table gives an empty result.

    Whole texts move once, dealt by ranges of ids, and are read in order as a stream; what the
    driver holds is one id for each range.
    """
    spark = docs.sparkSession
    base = common.documents(docs)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("cuts")).first()["cuts"]
    bounds = np.unique(np.array(cuts or [], np.int64))
    least = base.select("doc_id").mapInArrow(common.tidy(_least(bounds)), "bucket int, least long").groupBy("bucket").agg(F.min("least").alias("least")).collect()
    order = sorted((r["bucket"], r["least"]) for r in least)
    firsts = {first: order[i - 1][0] for i, (_, first) in enumerate(order)}  # for i = 0 the last bucket
    dealt = base.mapInArrow(common.tidy(_deal(bounds, firsts)), "bucket int, border int, doc_id long, text string")
    ranged = dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "border", "doc_id", F.xxhash64("text"))
    done = ranged.mapInArrow(common.tidy(_walk), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumn("doc_id", common.public_id("doc_id"))
