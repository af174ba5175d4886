"""N-gram Jaccard join with parity sketches.

The distinct word n-grams of a document are hashed to bits, and bits that are hit twice
cancel: a parity sketch. Two sketches differ in at most as many bits as the sets differ in
n-grams, so their Hamming distance is a lower bound of the symmetric difference, which for a
Jaccard similarity of t is at most (1 - t) / (1 + t) of the sum of the sizes.

Candidates. For a band of sizes a sparse sketch of many bits is divided into P pieces, and a
piece is known by the XOR of its bits. Two sets that differ in at most d n-grams touch at most
d pieces, so by the pigeonhole principle every d + 1 of the pieces that are not empty, taken in
one global order from either set, have one in common: a document is listed under d + 1 pieces
and no link is lost. The order puts pieces of frequent n-grams last, so that passages which many
documents share seldom make lists; that order is a hint that decides about work, not results.

Lists. Equal sets are one class with one representative. Short lists give their pairs. Of long
ones (groups of near copies, mostly) each block of members first gives only pairs with its most
central member; what is still in different components afterwards is compared block by block,
by sketch. So no list is gathered whole in a task and none gives all its pairs.

Verification. Pairs whose dense sketches differ in more bits than the bound allows go; for the
others the sets themselves are intersected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common
from motifel.llm.components import HOT_SHARE, groups, hot_keys, hot_lookup

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_U = np.uint64
SMALL = 64
"""Sets below this size have a piece for each n-gram; above, bands double in size."""
PIECE_LOAD = 1.5
"""n-grams per piece, at the upper end of a band. At 1.5 the chance that a set has fewer than d + 1 pieces that are not empty is below 1e-13."""
LEVELS = 1 << 21
"""Slots of the table of frequent n-grams (one byte each)."""
FREQUENT_HERE, FREQUENT = 4, 64
"""An n-gram counts as frequent from FREQUENT documents on, of those in partitions that have it FREQUENT_HERE times."""
BUCKET_RECORDS, SHORT_LIST, BLOCK = 400_000, 12, 1024
REMEMBERED = 150_000
RENAMED = 200_000
"""Classes at most that may need another name than their hash: they go to all workers. 64 bits let about n * n / 2 ** 65 of n different sets meet."""


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> _U(29)
    x *= _M2
    x ^= x >> _U(32)
    return x


class Shingles:
    """Sorted distinct hashes of the word n-grams of a text; words are remembered."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only, and at [\x20\x09-\x0D]+
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            w = np.array([known[x] for x in words], np.uint64)
        except KeyError:
            for x in set(words).difference(known):
                known[x] = xxhash.xxh3_64_intdigest(x)
            w = np.array([known[x] for x in words], np.uint64)
        k = min(self.n, len(w))
        if not k:
            return w
        h = np.full(len(w) - k + 1, k, np.uint64)
        for j in range(k):
            h ^= w[j : len(w) - k + 1 + j]
            h *= _M1
            h ^= h >> _U(31)
        return np.unique(_mix(h))


@lru_cache(2)
def _shingles(n: int) -> Shingles:
    """One memory for all tasks of a worker process."""
    return Shingles(n)


def dense_sketch(s: np.ndarray) -> bytes:
    """Parity of the low bits of the hashes; twice as many bits as n-grams, to a power of two.
    A sketch folds to half its width by the XOR of its halves."""
    width = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """All of them at the width of the narrowest, as rows of 64-bit words."""
    width = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, width // 8), axis=0) for s in sketches])


class Rule:
    """The threshold as a ratio num / den of whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def differ(self, both_sizes):
        """The largest symmetric difference that sets of these sizes, added up, may have."""
        return (self.den - self.num) * both_sizes // (self.den + self.num)

    def larger(self, n: int) -> int:
        """The largest size of a set that is linked with one of size n."""
        return self.den * n // self.num


def bands(n: int, rule: Rule) -> list[tuple[int, int, int]]:
    """(band, pieces or 0 for one each, pieces to list) of a set of n: its own band, and those above in which a larger partner may be."""
    out, most = [], rule.larger(n)
    k = 0 if n < SMALL else (n // SMALL).bit_length()
    while True:
        end = SMALL << k
        out.append((k, 0 if k == 0 else int(end / PIECE_LOAD), int(rule.differ(n + min(end - 1, most))) + 1))
        if most < end:
            return out
        k += 1


def listed(s: np.ndarray, level: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys of the pieces under which a set is listed. The lowest 8 bits of a key are its level of frequency."""
    each = level[(s & _U(LEVELS - 1)).astype(np.int64)]
    bits = _mix(s ^ _M2)
    out = []
    for band, pieces, wanted in bands(len(s), rule):
        if pieces:
            piece = ((s >> _U(32)) * _U(pieces)) >> _U(32)  # rises with s
            start = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            key = np.bitwise_xor.reduceat(bits, start) ^ (piece[start] * _M1)
            rank = np.minimum.reduceat(each, start)
        else:
            key, rank = bits, each
        key = _mix(key + _U(band))
        order = (rank.astype(np.uint64) << _U(56)) | (key >> _U(8))
        if len(order) > wanted:
            order = np.partition(order, wanted - 1)[:wanted]
        out.append((order << _U(8)) | (order >> _U(56)))
    return np.concatenate(out)


def _class(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


class Names:
    """The number of a class: the upper bits of its hash (64 but in tests), or the one it got because another class has those."""

    def __init__(self, bits: int, renamed: dict[bytes, int]):
        self.shift, self.renamed = 64 - bits, renamed

    def __call__(self, classes: list[bytes]) -> np.ndarray:
        named = np.frombuffer(b"".join(c[:8] for c in classes), ">i8").astype(np.int64) >> self.shift
        if self.renamed:
            for i, c in enumerate(classes):
                if c in self.renamed:
                    named[i] = self.renamed[c]
        return named


def _survey(n: int, names_of: Names):
    """Of each document its class, size and sketch; of each partition the n-grams that it has often, over different sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, heap, size = _shingles(n), set(), [], 0

        def frequent(parts):
            h, c = np.unique((np.concatenate(parts) & _U(LEVELS - 1)).astype(np.int32), return_counts=True)
            keep = c >= FREQUENT_HERE
            m = int(keep.sum())
            return pa.RecordBatch.from_arrays([*(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(h[keep]), pa.array(c[keep].astype(np.int64))], names)

        names = ["doc_id", "n", "node", "class", "sketch", "slot", "docs"]
        for b in batches:
            sizes, classes, sketches = [], [], []
            for text in common.as_bytes(b.column("text")):
                s = make(text)
                c = _class(s)
                sizes.append(len(s))
                classes.append(c)
                sketches.append(dense_sketch(s) if len(s) and c not in seen else None)
                if c not in seen and len(s):
                    seen.add(c)
                    heap.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names_of(classes)), pa.array(classes, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.int64())], names)
            if size > 1_500_000:  # 12 MB
                yield frequent(heap)
                heap, size = [], 0
        if heap:
            yield frequent(heap)

    return run


def _list_pieces(n: int, level, rule: Rule, bits: int, names):
    """Packed lists: for a batch of documents and a bucket of keys one row of keys and classes.
    A class is listed once by each partition, however many of its documents are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, table = _shingles(n), set(), level.value
        for b in batches:
            keys, classes = [], []
            for text in common.as_bytes(b.column("text")):
                s = make(text)
                if len(s) and (c := _class(s)) not in seen:
                    seen.add(c)
                    keys.append(listed(s, table, rule))
                    classes.append(c)
            if not keys:
                continue
            key, node = np.concatenate(keys), np.repeat(names.value(classes), [len(x) for x in keys])
            bucket = (key >> _U(64 - bits)).astype(np.int64)
            hot = (key & _U(255)) > 0  # lists of frequent n-grams are only handed through, dealt by class as well
            bucket[hot] = -1 - (_mix(key[hot] ^ node[hot].view(np.uint64)) >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, node, bucket = key[order], node[order], bucket[order]
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
            parts = list(zip(start, start[1:] + [len(key)], strict=True))
            # Keys of a bucket share their upper bits; 40 further ones keep chance meetings rare at any size, as buckets hold a fixed number of records.
            short = np.ascontiguousarray(((key << _U(bits)) >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :5])
            keys = [key[i:j].tobytes() if bucket[i] < 0 else short[i:j].tobytes() for i, j in parts]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(keys, pa.binary()), pa.array([node[i:j].tobytes() for i, j in parts], pa.binary())], ["bucket", "keys", "nodes"])

    return run


_MEET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])
"""A pair has no key, the place of a class in a long list no a."""


def _meet(t: pa.Table) -> pa.Table:
    """Pairs of short lists, and (key, class) of long ones, of a bucket."""
    bucket = t.column("bucket")[0].as_py()
    keys, nodes = t.column("keys").to_pylist(), t.column("nodes").to_pylist()
    node = np.frombuffer(b"".join(nodes), np.int64)
    if bucket < 0:
        key = np.frombuffer(b"".join(keys), np.int64)
        return pa.Table.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(node), pa.array(key)], schema=_MEET)
    wide = np.zeros((len(node), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 5)
    key = wide.reshape(-1).view(np.uint64)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[fresh], node[fresh]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    pairs = []
    for m in range(2, SHORT_LIST + 1):
        at = start[size == m]
        pairs += [np.stack([node[at + i], node[at + j]], 1) for i in range(m) for j in range(i + 1, m)]
    p = np.unique(np.concatenate(pairs), axis=0)
    long = np.repeat(size > SHORT_LIST, size)
    m = int(long.sum())
    whole = key[long].view(np.int64) + (bucket << 40)
    a = pa.concat_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.nulls(m, pa.int64())])
    b = pa.concat_arrays([pa.array(np.ascontiguousarray(p[:, 1])), pa.array(node[long])])
    k = pa.concat_arrays([pa.nulls(len(p), pa.int64()), pa.array(whole)])
    return pa.Table.from_arrays([a, b, k], schema=_MEET)


def _within(sketches: np.ndarray, n: np.ndarray, i: int, among: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of among may be linked with i, by size and by Hamming distance."""
    far = np.bitwise_count(sketches[among] ^ sketches[i]).sum(axis=1).astype(np.int64)
    small, large = np.minimum(n[among], n[i]), np.maximum(n[among], n[i])
    return (far <= rule.differ(n[among] + n[i])) & (rule.den * small >= rule.num * large)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[np.ndarray]) -> pa.Table:
    p = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    p = np.unique(np.sort(p, axis=1), axis=0)
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], schema=_PAIRS)


def _stars(rule: Rule):
    """Of a block of a long list: each member with the most central one, the one nearest to the majority of each bit; members that this leaves out, again among themselves, a few times."""

    def run(t: pa.Table) -> pa.Table:
        ids, n = t.column("node").to_numpy(), t.column("n").to_numpy()
        sketches = folded(t.column("sketch").to_pylist())
        coarse = np.bitwise_xor.reduce(sketches.reshape(len(ids), -1, min(32, sketches.shape[1])), axis=1)  # 2048 bits at most, to find the middle
        found, rest = [], np.arange(len(ids))
        for _ in range(4):
            if len(rest) < 2:
                break
            ones = np.unpackbits(coarse[rest].view(np.uint8), axis=1).astype(np.float32)
            centre = rest[np.argmin(ones @ (1 - 2 * ones.mean(axis=0)))]
            others = rest[rest != centre]
            near = _within(sketches, n, centre, others, rule)
            found.append(np.stack([np.full(near.sum(), ids[centre]), ids[others[near]]], 1))
            rest = others[~near]
        return _pairs(found)

    return run


def _across(rule: Rule):
    """Pairs of two blocks of a long list that are in different components and may be linked."""

    def run(t: pa.Table) -> pa.Table:
        ids, n, comp, side = (t.column(c).to_numpy() for c in ("node", "n", "comp", "own"))
        left = np.flatnonzero(side == t.column("i")[0].as_py())
        right = left if t.column("i")[0].as_py() == t.column("j")[0].as_py() else np.flatnonzero(side == t.column("j")[0].as_py())
        sketches = folded(t.column("sketch").to_pylist())
        found = []
        for x in left.tolist():
            other = right[comp[right] != comp[x]]
            near = other[_within(sketches, n, x, other, rule)] if len(other) else other
            if len(near):
                found.append(np.stack([np.full(len(near), ids[x]), ids[near]], 1))
        return _pairs(found)

    return run


def _sets(n: int, wanted, bits: int, names):
    """Sets of the documents whose ids may be wanted: a bit table of fixed size tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, table = _shingles(n), np.frombuffer(wanted.value, np.uint8)
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            at = _mix(ids.astype(np.uint64)) >> _U(64 - bits)
            hit = np.flatnonzero((table[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1)
            sets = [make(x) for x in common.as_bytes(b.column("text").take(pa.array(hit)))]
            yield pa.RecordBatch.from_arrays([pa.array(names.value([_class(x) for x in sets])), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "grams"])

    return run


def _mark(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _mix(b.column("id").to_numpy().astype(np.uint64)) >> _U(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at >> _U(16)).astype(np.int64)), pa.array(_chunks(at), pa.binary())], ["chunk", "marks"])

    return run


def _chunks(at: np.ndarray) -> list[bytes]:
    out = []
    for c in np.unique(at >> _U(16)):
        bits = np.zeros(1 << 16, np.uint8)
        bits[(at[(at >> _U(16)) == c] & _U(65535)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def _or(t: pa.Table) -> pa.Table:
    marks = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("marks").to_pylist()], axis=0)
    return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int64()), "marks": pa.array([marks.tobytes()], pa.binary())})


def _verify(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("ga").to_pylist(), b.column("gb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(rule.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return run


def _close(rule: Rule):
    """Pairs that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
            for m, k, x, y in zip(na, nb, b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                two = folded([x, y])
                keep.append(rule.den * min(m, k) >= rule.num * max(m, k) and int(np.bitwise_count(two[0] ^ two[1]).sum()) <= rule.differ(m + k))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

    return run


FILTER_BITS = 26
"""Of the table of wanted documents: 8 MB. It only spares moving sets that no pair needs; the join decides."""


def _linked(pairs: DataFrame, classes: DataFrame, base: DataFrame, n: int, rule: Rule, names) -> DataFrame:
    """Those of the pairs of classes whose sets are linked."""
    spark = base.sparkSession
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = ends.join(classes.select("node", "rep"), "node").select(F.col("rep").alias("id"))
    chunks = ids.mapInArrow(common.tidy(_mark(FILTER_BITS)), "chunk long, marks binary").groupBy("chunk").applyInArrow(_or, "chunk long, marks binary").collect()  # 1024 rows of 8 KB at most
    table = bytearray(1 << (FILTER_BITS - 3))
    for r in chunks:
        table[r["chunk"] << 13 : (r["chunk"] + 1) << 13] = bytes(r["marks"])
    wanted = spark.sparkContext.broadcast(bytes(table))
    sets = base.mapInArrow(common.tidy(_sets(n, wanted, FILTER_BITS, names)), "node long, grams binary")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    return common.cut(full.select("a", "b", "ga", "gb").mapInArrow(common.tidy(_verify(rule)), "a long, b long").distinct(), "linked")


def _table(frequent: DataFrame) -> np.ndarray:
    """A byte for each slot of hashes: 0, or about twice the logarithm of how many documents have such an n-gram."""
    rows = frequent.groupBy("slot").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= FREQUENT)
    got = rows.select("slot", F.least(F.lit(255), F.floor(2 * F.log2("docs"))).cast("int").alias("level")).toArrow()  # LEVELS rows at most
    table = np.zeros(LEVELS, np.uint8)
    table[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return table


def _renamed(rows: DataFrame, classes: DataFrame) -> dict[bytes, int]:
    """New numbers of the classes that share one, but for the first of each number."""
    clash = [r["node"] for r in classes.where("low <> high").select("node").limit(RENAMED + 1).collect()]  # nearly always none
    if not clash:
        return {}
    spark = rows.sparkSession
    met = rows.where("n > 0").join(F.broadcast(spark.createDataFrame([(x,) for x in clash], "node long")), "node").select("node", "class").distinct().limit(RENAMED + 1).collect()
    if len(met) > RENAMED:
        raise ValueError(f"more than {RENAMED} sets share a number")
    open_, first = [], set()
    for r in sorted(met, key=lambda r: (r["node"], bytes(r["class"]))):
        if r["node"] in first:
            open_.append(bytes(r["class"]))
        first.add(r["node"])
    out: dict[bytes, int] = {}
    seed = 0
    while open_:
        seed += 1
        tried = {c: int.from_bytes(xxhash.xxh3_64_digest(c, seed), "big", signed=True) for c in open_}
        wanted = spark.createDataFrame([(x,) for x in set(tried.values())], "node long")
        taken = {r["node"] for r in classes.join(F.broadcast(wanted), "node").select("node").collect()} | set(out.values())
        for c, x in tried.items():
            if x not in taken:
                out[c] = x
                taken.add(x)
        open_ = [c for c in open_ if c not in out]
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """(node, rep, n, sketch, docs, low, high): a row for each number; low and high differ if different sets have it."""
    each = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.count("*").alias("docs"), F.min("class").alias("low"), F.max("class").alias("high"))
    return common.cut(each, "classes")


def ngram_groups(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (75, 100), name_bits: int = 64) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    A document's set: the distinct n-grams of its words (runs of ``[^\\x20\\x09-\\x0D]``, A-Z
    lower-cased); with fewer words, all of them as one; without words, or of a null text, it
    is empty and linked with nothing. Two documents are linked if den * intersection >=
    num * union, threshold being (num, den). component_id is the smallest doc_id that links
    reach, the own one included. Rows that repeat a doc_id are documents with texts of their
    own that share an id. A null id is below all others, so a component with one has a null
    component_id. n-grams are known by 64-bit hashes, sets by 128 bits of those; the 64-bit numbers
    by which sets are joined are made different where they meet (name_bits: fewer, for tests). An
    empty table gives an empty result. No list, group or pair is capped.
    """
    spark = docs.sparkSession
    rule = Rule(*threshold)
    base = common.documents(docs)
    schema = "doc_id long, n long, node long, class binary, sketch binary, slot int, docs long"
    found = common.cut(base.mapInArrow(common.tidy(_survey(n, Names(name_bits, {}))), schema), "survey")
    rows = found.where(F.col("slot").isNull())
    classes = _classes(rows)
    renamed = _renamed(rows, classes)
    if renamed:
        other = F.broadcast(spark.createDataFrame([(bytearray(c), x) for c, x in renamed.items()], "other binary, name long"))  # RENAMED rows at most
        rows = rows.join(other, F.col("class") == F.col("other"), "left").withColumn("node", F.coalesce("name", "node"))
        classes = _classes(rows)
    names = spark.sparkContext.broadcast(Names(name_bits, renamed))
    n_rows, total = classes.agg(F.sum("docs"), F.sum("n")).first()
    n_rows, total = n_rows or 0, total or 0
    bits = max(1, min(22, (total // (2 * BUCKET_RECORDS)).bit_length()))
    level = spark.sparkContext.broadcast(_table(found.where(F.col("slot").isNotNull())))
    lists = base.mapInArrow(common.tidy(_list_pieces(n, level, rule, bits, names)), "bucket long, keys binary, nodes binary")
    met = common.cut(lists.groupBy("bucket").applyInArrow(_meet, "a long, b long, key long"), "met")

    sides = lambda df: (
        df.join(classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(common.tidy(_close(rule)), "a long, b long")
    )
    short = sides(met.where(F.col("key").isNull()).select("a", "b").distinct())

    # Long lists: those with the same members (by 128 bits of them) are one; a list is worked on in blocks of its members.
    # Sketches join last and in the order of their sets, so that those that move for several lists stand together and pack well.
    listing = met.where(F.col("key").isNotNull()).select("key", F.col("b").alias("node")).distinct()
    signs = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sign{i}") for i in range(2)]
    sized = common.cut(listing.groupBy("key").agg(F.count("*").alias("size"), *signs), "lists")
    n_listed = sized.agg(F.sum("size")).first()[0] or 0
    lists = sized.where("size > 1").groupBy("size", "sign0", "sign1").agg(F.min("key").alias("k"))
    lists = common.cut(lists.select("k", F.ceil(F.col("size") / BLOCK).cast("long").alias("value")), "lists-kept")
    hot_lists = common.cut(sized.where(F.col("size") * HOT_SHARE > n_listed).select(F.col("key").alias("k")), "hot")
    member = hot_lookup(listing, F.col("key"), n_listed, lists, hot_lists, "blocks").where(F.col("blocks").isNotNull())
    member = common.cut(member.select("key", "node", F.col("blocks").cast("int").alias("blocks"), F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int").alias("own")), "long-lists")
    sketched = lambda df: df.join(classes.select("node", "n", "sketch"), "node").sortWithinPartitions("node")
    stars = sketched(member).groupBy("key", "own").applyInArrow(_stars(rule), "a long, b long").distinct()
    tried = common.cut(short.union(stars).distinct(), "candidates")
    linked = _linked(tried, classes, base, n, rule, names)

    labels = common.cut(groups(linked), "groups")
    placed = member.join(labels, F.col("node") == F.col("v"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("v")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(F.col("key").alias("k"), F.lit(1).cast("long").alias("value"))
    mixed = common.cut(mixed, "mixed-lists")
    dealt = sketched(hot_lookup(placed, F.col("key"), n_listed, mixed, hot_lists, "open").where(F.col("open").isNotNull()))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "node", "n", "comp", "sketch")
    across = dealt.groupBy("key", "i", "j").applyInArrow(_across(rule), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    across = common.cut(across, "candidates-across")
    if across.limit(1).count():
        labels = common.cut(groups(linked.union(_linked(across, classes, base, n, rule, names))), "groups")

    # A class that is linked with none is a component of its own; its smallest id is known already.
    named = common.cut(labels.join(classes.select("node", "rep"), F.col("v") == F.col("node")).select("node", "rep", "comp"), "named")
    n_named = named.count()
    first = named.groupBy(F.col("comp").alias("k")).agg(F.min("rep").alias("value"))
    linked_ones = hot_lookup(named, F.col("comp"), n_named, first, hot_keys(named, "comp", n_named), "first").select(F.col("node").alias("k"), F.col("first").alias("value"))
    alone = classes.join(labels, F.col("node") == F.col("v"), "left_anti").select(F.col("node").alias("k"), F.col("rep").alias("value"))
    place = common.cut(linked_ones.union(alone), "places")
    hot = classes.where(F.col("docs") * HOT_SHARE > n_rows).select(F.col("node").alias("k"))
    with_words = hot_lookup(rows.where("n > 0").select("doc_id", "n", "node"), F.col("node"), n_rows, place, hot, "first")
    empty = rows.where("n = 0").select("doc_id", "n", "node", F.col("doc_id").alias("first"))
    done = with_words.union(empty)
    return done.select(common.public_id("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("first") != common.NULL_ID, F.col("first")).alias("component_id"))
