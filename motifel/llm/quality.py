"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer
network in numpy with temperature-calibrated probabilities.

Every word of a text gives two terms: its letters in lower case, and its shape (runs of
letters, capitals and digits as one sign each, other signs as they are, and whether it
repeats the word before). A term's index vector is sparse, ternary and follows from its
hash. Its word vector is its index vector plus the normalised sum of the index vectors of
its neighbours, gathered over the texts of all documents. A document is the mean of
the word vectors of all its words, of each kind.

Two things are bounded. The training sample: ``MAX_TRAIN`` labelled rows, of the ids with the
smallest hashes; where ids repeat, the rows with the smallest hashes of id and text. The word vectors: ``TERMS`` buckets of each kind of term, so that
words whose hashes fall into one bucket share its vector. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common

MAX_TRAIN = 20_000
"""Labelled rows to learn from, at most."""
TERMS, DIM, NONZERO, WINDOW = 1 << 14, 64, 6, 2
"""Hash buckets of each kind of term (the shapes of repeated words are the upper half), length and entries of index vectors, neighbours on each side."""
PRIOR = 10
MIN_STEPS = 2000
"""Steps of the network's training at least, for small samples."""
REMEMBERED = 200_000
CHUNKS = 32
"""Parts in which the sums of word vectors are added up."""
BLOCK, FULL = 1 << 16, (1 << 31) // (2 * WINDOW * NONZERO) - 1
"""Words of a text that are worked on at once, and words of which 32 bits hold all sums."""
_SHAPE = [(re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "9")]
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: The same for words of ASCII signs: what is stripped, and the sign that stands for each.
_STRIPPED = bytes(c for c in range(128) if not chr(c).isalnum())
_SIGNS = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUNS, _TEXT_RUNS = re.compile(rb"(?<=a)a+|(?<=A)A+|(?<=9)9+"), re.compile(r"(?<=a)a+|(?<=A)A+|(?<=9)9+")


class _Signs(dict):
    """For ``str.translate``: the sign that stands for each character, found when it is first seen."""

    def __missing__(self, c: int) -> str:
        self[c] = sign = next((sign for pattern, sign in _SHAPE if pattern.fullmatch(chr(c))), chr(c))
        return sign


_SIGN_OF = _Signs()


def index_vectors(seed: int) -> np.ndarray:
    """The index vectors of all buckets of a kind."""
    rng = np.random.default_rng(seed)
    out = np.zeros((TERMS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(TERMS), rng.integers(0, DIM, TERMS)] += rng.choice(np.array([-1, 1], np.float32), TERMS)
    return out


class Terms:
    """Words to buckets; remembers a bounded number of them."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.shapes: dict[bytes | str, int] = {}

    def both(self, w: bytes) -> int:
        """The buckets of a word and of its shape, as one number."""
        half = TERMS // 2
        if w.isascii():
            signs = w.translate(_SIGNS)
            shape = self.shapes.get(signs)
            if shape is None:
                shape = self.shapes[signs] = xxhash.xxh3_64_intdigest(_RUNS.sub(b"", signs)) % half
            return xxhash.xxh3_64_intdigest(w.strip(_STRIPPED).lower()) % TERMS * half + shape
        s = w.decode("utf-8", "replace")
        signs = s.translate(_SIGN_OF)
        shape = self.shapes.get(signs)
        if shape is None:
            shape = self.shapes[signs] = xxhash.xxh3_64_intdigest(_TEXT_RUNS.sub("", signs)) % half
        bare = s if s[0].isalnum() and s[-1].isalnum() else _EDGES.sub("", s)
        return xxhash.xxh3_64_intdigest(bare.lower()) % TERMS * half + shape

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
            self.shapes.clear()
        for w in set(words).difference(known):
            known[w] = self.both(w)
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        lexical, shape = both // (TERMS // 2), both % (TERMS // 2)
        shape[1:] += (both[1:] == both[:-1]) * (TERMS // 2)
        return lexical, shape


def _near(ids: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Adds to each bucket the index vectors of its neighbours in a text; whole numbers, so in any order."""
    for at in range(0, len(ids), BLOCK):
        low, high = max(0, at - WINDOW), min(len(ids), at + BLOCK + WINDOW)
        each = index[ids[low:high]]
        near = np.zeros_like(each)
        for step in range(1, WINDOW + 1):
            near[step:] += each[:-step]
            near[:-step] += each[step:]
        own, near = ids[at : at + BLOCK], near[at - low :][:BLOCK]
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        into[own[order][starts]] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int32)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the index vectors of the neighbours of each bucket, over the rows of the task."""
    terms, own = Terms(), [index_vectors(1).astype(np.int8), index_vectors(2).astype(np.int8)]
    total, words = [np.zeros((TERMS, DIM), np.int32) for _ in own], 0

    def sums() -> Iterator[pa.RecordBatch]:
        for kind, t in enumerate(total):
            parts = [p.tobytes() for p in np.split(t, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["kind", "chunk", "sums"])
            t[:] = 0

    for b in batches:
        for text in common.as_bytes(b.column("text")):
            both = terms(text)
            if words + len(both[0]) > FULL:
                yield from sums()
                words = 0
            words += len(both[0])
            for ids, index, into in zip(both, own, total, strict=True):
                _near(ids, index, into)
    yield from sums()


def _added(t: pa.Table) -> pa.Table:
    """The sum of a chunk over the tasks."""
    total = np.zeros(TERMS // CHUNKS * DIM, np.int64)
    for x in t.column("sums"):
        total += np.frombuffer(x.as_py(), np.int32)
    return pa.table({"kind": t.column("kind").slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def pooled(texts: list[bytes], vectors: list[np.ndarray], terms: Terms) -> np.ndarray:
    """A row per text: the mean word vector of each kind, and the number of words."""
    out = np.zeros((len(texts), 2 * DIM + 1), np.float32)
    for row, text in zip(out, texts, strict=True):
        for k, ids in enumerate(terms(text)):
            row[-1] = len(ids)
            if len(ids):
                used, n = np.unique(ids, return_counts=True)
                row[k * DIM : (k + 1) * DIM] = (n.astype(np.float32) @ vectors[k][used]) / len(ids)
    return out


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            x = pooled(common.as_bytes(b.column("text")), vectors.value, terms)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    return run


@dataclass
class Network:
    """Inputs scaled, one hidden layer of tanh, one output; probabilities at a temperature.
    A text of few words counts as if PRIOR words of the average text were added to it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        n = x[:, -1:]
        return (x[:, :-1] - self.mean) / self.scale * (n / (n + PRIOR))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the temperature minimises the log loss of the last fifth."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    width = x.shape[1] - 1
    net = Network(x[own, :-1].mean(0), x[own, :-1].std(0) + 1e-2, rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = net.inputs(x)
    batches = max(1, len(own) // 128)
    for _ in range(max(epochs, -(-MIN_STEPS // batches))):
        for part in np.array_split(rng.permutation(own), batches):
            h = np.tanh(z[part] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[part]) / len(part)
            gh = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[part].T @ gh + 1e-3 * params[0], gh.sum(0), h.T @ g + 1e-3 * params[2], np.array([g.sum()])]
            t += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                params[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        logit = net.logits(x[held])

        def loss(temperature: float) -> float:
            s = np.clip(logit / temperature, -40, 40)
            return float(np.mean(np.logaddexp(0, s) - y[held] * s))

        net.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, folds: int = 5) -> tuple[list[np.ndarray], Network]:
    """Word vectors from all documents; network from labelled rows with crc32(id as text) mod folds other than 0."""
    spark = docs.sparkSession
    chosen = (
        labels.select(common.internal_id("doc_id").alias("l_id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isNotNull() & (F.crc32(F.col("l_id").cast("string")) % folds != 0))
        .groupBy("l_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("l_id"), "l_id").limit(max_train)
    )
    chosen = spark.createDataFrame(chosen.collect(), "l_id long, label int")  # max_train rows at most
    sample = common.documents(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label")
    sample = sample.dropDuplicates(["doc_id", "text"]).withColumn("at", F.xxhash64("doc_id", "text"))  # a row that is there twice teaches nothing new
    sample = common.cut(sample.repartition(8, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "text"), "quality-sample")
    if sample.count() > max_train:  # ids that stand for several texts: rows are bounded too
        last = sample.select("at").orderBy("at").limit(max_train).agg(F.max("at")).first()[0]
        sample = sample.where(F.col("at") <= last)
    sums = "kind int, chunk int, sums binary"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that the sums that move do not grow with the input
    parts = common.documents(docs).select("text").coalesce(tasks).mapInArrow(common.tidy(_contexts), sums).groupBy("kind", "chunk").applyInArrow(_added, sums).toArrow().to_pylist()  # 2 * CHUNKS rows of fixed size
    vectors = []
    for kind in (0, 1):
        own = index_vectors(kind + 1)
        total = np.zeros((TERMS, DIM))
        for r in parts:
            if r["kind"] == kind:
                np.split(total, CHUNKS)[r["chunk"]][:] = np.frombuffer(r["sums"], np.int64).reshape(-1, DIM)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        vectors.append((own / np.linalg.norm(own, axis=1, keepdims=True).clip(1) + total / np.maximum(size, 1e-9)).astype(np.float32))
    del parts
    shared = spark.sparkContext.broadcast(vectors)
    rows = sample.mapInArrow(common.tidy(_features(shared)), "doc_id long, label int, x binary").orderBy("doc_id", "x").toArrow()  # max_train rows of fixed size
    if not rows.num_rows:  # nothing to learn from
        d = 2 * DIM
        return vectors, Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, -1)
    net = train(x, rows.column("label").to_numpy().astype(np.float32))
    del rows, x
    common.give_back()
    return vectors, net


def _score(model, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        vectors, net = model.value
        for b in batches:
            s = net.scores(pooled(common.as_bytes(b.column("text")), vectors, terms).astype(np.float64)).round(9)  # the last digits depend on the batch
            rest = [c for c in b.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(s)], [*rest, "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = MAX_TRAIN, folds: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted.

    held_out: crc32(id as text) mod folds is 0; such rows are never learnt from. predicted is 1
    from the threshold on. Empty and null texts get the score of a document without words;
    without any labelled row all scores are 0.5. Rows that repeat an id are scored each. A
    null id counts as the smallest integer for its fold. ``carry``: columns of docs to hand
    through, text among them if wished. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train, folds))  # of fixed size
    keep_text, others = "text" in carry, [c for c in carry if c != "text"]
    base = common.documents(docs, *others)
    if others:
        base = base.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("carried"))
    kind = dict(base.dtypes)
    schema = ", ".join([f"{c} {kind[c]}" for c in base.columns if keep_text or c != "text"] + ["score double"])
    held = (F.crc32(F.col("doc_id").cast("string")) % folds == 0).alias("held_out")
    out = base.mapInArrow(common.tidy(_score(model, keep_text)), schema)
    return out.select(common.public_id("doc_id").alias("doc_id"), held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["text"] if keep_text else []), *[F.col("carried")[c].alias(c) for c in others])
