"""Best-fit packing by a grouping genetic algorithm, distributed as islands.

Documents become token ids and one end id; those longer than the capacity are cut into
pieces of it. Full pieces are sequences as they are. The others are dealt by hash to blocks
of about ``block_items``, and each block is evolved on several islands at once: an island
holds a few packings, made by best fit over differing orders. Crossover injects whole
well-filled sequences of one packing into another, removes the sequences that hold
duplicates of them, and places the displaced documents again by best fit. A round goes
on until a number of generations gave nothing better; then an island sends its elite to the next island
of its block. Fitness is the number of sequences, then how far what stays free is gathered in few of
them; only a packing with no more than one sequence that is not full is not evolved further, as none is
better.

Blocks merge in a tree: the emptiest sequences of ``FAN`` neighbours are opened, and their
items are a block of the next level, evolved in the same way from the packing that they had and
from new ones. So what every block leaves free comes together, and the last block alone may
leave a sequence partly empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common
from motifel.llm.units import Memory

CAPACITY, BLOCK_ITEMS, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2048, 4096, 2, 2, 16, 4
"""GENERATIONS: a round of an island ends when so many have given no better packing, however many there were."""
FAN = 8
"""Blocks that one of the next level takes the open sequences of; each gives at most its share of a block's items."""
PLACED, MOST_PATIENCE, MOST_PACKINGS = 16_384, 300, 24
"""In small blocks more generations without a better packing are waited for, as many as place so many items, but at most so many, and there are more packings."""
REMEMBERED = 400_000
"""Different words whose ids a worker remembers."""


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _blob(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1)
def _words(path: str) -> Memory:
    """Ids of white-space separated words. The tokenizer drops white space and never looks
    across it, so a text's ids are those of its words one after another. One memory for all
    tasks of a worker process."""
    return Memory(path, _text, _blob, REMEMBERED)


_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _words(path)
        for b in batches:
            docs = [x.split() for x in common.as_bytes(b.column("text"))]  # of bytes: at [\x20\x09-\x0D]+
            memory.learn(set().union(*docs))
            rows = []
            for doc_id, words in zip(b.column("doc_id").to_pylist(), docs, strict=True):
                ids = b"".join(map(memory.known.__getitem__, words)) + end
                for k in range(0, len(ids) // 4, capacity):
                    part = ids[4 * k : 4 * (k + capacity)]
                    rows.append((doc_id, k // capacity, k, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(items: list[int], length: list[int], place: list[int], room: list[int], capacity: int) -> None:
    """Places items in their order, each where it leaves the least room, else in a new sequence.
    One bit for each room that some sequence has finds the least sufficient one at once."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for s, r in enumerate(room):
        if r:
            by_room[r].append(s)
            mask |= 1 << r
    for i in items:
        n = length[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            s = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            s, r = len(room), capacity
            room.append(r)
        room[s] = r = r - n
        if r:
            by_room[r].append(s)
            mask |= 1 << r
        place[i] = s


def renumbered(place: np.ndarray) -> np.ndarray:
    return np.unique(place, return_inverse=True)[1].astype(np.int32)


def fitness(place: np.ndarray, length: np.ndarray) -> tuple[int, float]:
    """Smaller is better: sequences, then how unevenly they are filled (some full ones and an empty one beat equal ones)."""
    fill = np.bincount(place, length)
    return len(fill), -float(np.square(fill).sum())


def fresh(length: np.ndarray, rng: np.random.Generator, noise: float, capacity: int) -> np.ndarray:
    order = np.argsort(-(length * (1 + noise * rng.random(len(length)))), kind="stable")
    place, room = [0] * len(length), []
    best_fit(order.tolist(), length.tolist(), place, room, capacity)
    return np.array(place, np.int32)


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child of a with whole well-filled sequences of b."""
    fill = np.bincount(b, length)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, rng.integers(1, max(1, len(good) // 2) + 1), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    own = np.bincount(a, length)
    hit[np.argsort(own)[: max(1, len(own) // 50)]] = True  # mutation: the emptiest ones are dissolved, and one more
    hit[rng.integers(len(own))] = True
    kept = ~hit[a] & ~injected
    child = np.full(len(a), -1, np.int64)
    child[injected] = b[injected]
    child[kept] = len(fill) + a[kept].astype(np.int64)
    placed = child >= 0
    child[placed] = renumbered(child[placed])
    room = (capacity - np.bincount(child[placed], length[placed]).astype(np.int64)).tolist()
    rest = np.flatnonzero(~placed)
    place = child.tolist()
    noise = rng.random(len(rest)) * rng.choice([0, 0.2, 1])
    best_fit(rest[np.argsort(-length[rest] * (1 + noise), kind="stable")].tolist(), length.tolist(), place, room, capacity)
    return renumbered(np.array(place))


def perfect(place: np.ndarray, length: np.ndarray, capacity: int) -> bool:
    """At most one sequence is not full."""
    return int((np.bincount(place, length) < capacity).sum()) <= 1


def evolve(population: list[np.ndarray], length: np.ndarray, seed: int, generations: int | None, size: int, capacity: int, patience: int | None = None) -> tuple[list[np.ndarray], int]:
    """The population after so many generations (None: no limit), best first, and how many there were: fewer
    where a packing is perfect, or no better one came for ``patience`` generations."""
    rng = np.random.default_rng(seed)
    ranked = sorted(((fitness(p, length), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    best, since, g = ranked[0][0], 0, 0
    for g in count() if generations is None else range(generations):
        if perfect(ranked[0][2], length, capacity) or (patience and since >= patience):
            return [p for _, _, p in ranked], g
        while len(ranked) < max(2, size):  # also in the place of packings as good as another, so that some variety stays
            p = fresh(length, rng, 0.5 * rng.random(), capacity)
            ranked.append((fitness(p, length), len(ranked), p))
        i, j = rng.choice(len(ranked), 2, replace=False)
        for x, y in ((ranked[i][2], ranked[j][2]), (ranked[j][2], ranked[i][2])):
            child = crossover(x, y, length, rng, capacity)
            ranked.append((fitness(child, length), 1000 + g, child))
        ranked = sorted(ranked, key=lambda x: x[:2])
        ranked = [x for k, x in enumerate(ranked) if not k or x[0] != ranked[k - 1][0]][:size]
        best, since = (ranked[0][0], 0) if ranked[0][0] < best else (best, since + 1)
    return [p for _, _, p in ranked], generations or 0


_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("migrant", pa.bool_()), ("pids", pa.binary()), ("lengths", pa.binary()), ("packings", pa.list_(pa.binary()))])
_STATE_SQL = "block long, island int, migrant boolean, pids binary, lengths binary, packings array<binary>"


def _states(block: int, island: int, pids: bytes, length: np.ndarray, population: list[np.ndarray], islands: int) -> pa.Table:
    blobs = [p.astype(np.int32).tobytes() for p in population]
    rows = [(block, island, False, pids, length.tobytes(), blobs)]
    if islands > 1:
        rows.append((block, (island + 1) % islands, True, b"", b"", blobs[:1]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATE, strict=True)], schema=_STATE)


def _found(islands: int, capacity: int):
    """The first packings of an island, longest items first, equal ones by number; the first island of a merged block begins with the packing that its items had."""

    def run(t: pa.Table) -> pa.Table:
        pids, length = t.column("pid").to_numpy(), t.column("length").to_numpy().astype(np.int64)
        order = np.lexsort((pids, -length))
        block, island = t.column("block")[0].as_py(), t.column("island")[0].as_py()
        had = t.column("had").combine_chunks().take(pa.array(order))
        pids, length = pids[order], length[order]
        rng = np.random.default_rng([block, island])
        population = [fresh(length, rng, 0.05 * island, capacity)]
        if not island and not had.null_count:
            population.append(renumbered(had.to_numpy()))
        return _states(block, island, pids.astype(np.int64).tobytes(), length, population, islands)

    return run


def _round(k: int, islands: int, generations: int, population: int, capacity: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if not r["migrant"])
        length = np.frombuffer(own["lengths"], np.int64)
        packings = [np.frombuffer(p, np.int32) for r in sorted(rows, key=lambda r: r["migrant"]) for p in r["packings"]]
        seed = own["block"] * 1009 + own["island"] * 101 + k
        patience = max(generations, min(MOST_PATIENCE, PLACED // len(length)))
        size = max(population, min(MOST_PACKINGS, PLACED // (32 * len(length))))
        return _states(own["block"], own["island"], own["pids"], length, evolve(packings, length, seed, None, size, capacity, patience)[0], islands)

    return run


_PLACED = pa.schema([("block", pa.int64()), ("pid", pa.int64()), ("length", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
_PLACED_SQL = "block long, pid long, length int, sequence_id long, offset long, open boolean"


def opened(place: np.ndarray, length: np.ndarray, most: int, capacity: int) -> np.ndarray:
    """Which sequences are opened: the emptiest, of together at most ``most`` items; full ones never."""
    fill, items = np.bincount(place, length), np.bincount(place)
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < capacity]
    chosen = np.zeros(len(fill), bool)
    chosen[order[np.cumsum(items[order]) <= most]] = True
    return chosen


def _choose(level: int, most: int, capacity: int):
    """The best island's packing of a block, as rows; up to ``most`` items of its emptiest sequences are open."""

    def run(t: pa.Table) -> pa.Table:
        best = None
        for r in sorted(t.to_pylist(), key=lambda r: r["island"]):
            length, place = np.frombuffer(r["lengths"], np.int64), np.frombuffer(r["packings"][0], np.int32)
            key = fitness(place, length)
            if best is None or key < best[0]:
                best = key, r, length, renumbered(place)
        _, r, length, place = best
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(length[order])
        starts = np.searchsorted(place[order], np.arange(place.max() + 1))
        base = np.concatenate([[0], ends])[starts]
        offset = np.empty(len(place), np.int64)
        offset[order] = ends - length[order] - base[place[order]]
        pids, block = np.frombuffer(r["pids"], np.int64), r["block"]
        sequence = (level << 56) + (block << 24) + place.astype(np.int64)
        columns = np.full(len(pids), block, np.int64), pids, length.astype(np.int32), sequence, offset, opened(place, length, most, capacity)[place]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_PLACED)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizer (path of a file whose pre-tokenizer drops white
    space) and end_id; only those longer than capacity are cut. In a sequence the pieces stand
    one after another from offset 0 without gaps. A null or empty text is the end id alone. Rows that
    repeat an id are packed each. A null id stays null. An empty table gives an empty result.
    """
    if block_items >= 1 << 24:
        raise ValueError("a block holds fewer than 2 ** 24 items")
    base = common.documents(docs)
    pieces = base.mapInArrow(common.tidy(_pieces(tokenizer, capacity, end_id)), _PIECE)
    pieces = common.cut(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    items = pieces.where(F.col("length") < capacity)
    blocks, level, done = max(1, -(-items.count() // block_items)), 0, []
    rows = items.select(F.pmod(F.xxhash64("pid"), F.lit(blocks)).alias("block"), "pid", "length", F.lit(None).cast("long").alias("had"))
    while True:
        dealt = rows.select("block", F.explode(F.lit(list(range(islands)))).alias("island"), "pid", "length", "had")
        state = dealt.groupBy("block", "island").applyInArrow(_found(islands, capacity), _STATE_SQL)
        for k in range(rounds):
            state = state.groupBy("block", "island").applyInArrow(_round(k, islands, generations, population, capacity), _STATE_SQL)
        most = max(8, block_items // FAN) if blocks > 1 else 0
        placed = common.cut(state.where(~F.col("migrant")).groupBy("block").applyInArrow(_choose(level, most, capacity), _PLACED_SQL), "packed")
        done.append(placed.where(~F.col("open")).select("pid", "sequence_id", "offset"))
        if blocks == 1:
            break
        rows = placed.where("open").select(F.expr(f"block div {FAN}").alias("block"), "pid", "length", F.col("sequence_id").alias("had"))
        blocks, level = -(-blocks // FAN), level + 1
    some = items.join(reduce(DataFrame.unionByName, done), "pid")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    names = ["piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"]
    return some.unionByName(full).select(common.public_id("doc_id").alias("doc_id"), *names)
