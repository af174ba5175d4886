import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from motifel.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected_pieces(rows, capacity):
    t = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), capacity):
            out.append((r[0], k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())))
    return cases.norm(out)


def check(rows, got, capacity):
    assert cases.norm((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(rows, capacity)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity,block,islands", [(64, 7, 3), (2048, 4096, 2), (100, 10, 1)])
def test_hard_cases(spark, capacity, block, islands):
    rows = cases.hard_rows()
    got = packing.pack(cases.table(spark, rows), PATH, capacity=capacity, block_items=block, islands=islands).collect()
    used = check(rows, got, capacity)
    assert used <= 1.01 * sum(r.length for r in got) / capacity + 3  # blocks of 7 leave more open than real ones
    assert packing.pack(cases.table(spark, []), PATH).collect() == []


def least_sequences(sizes, capacity):
    """The optimum, by trying all ways to go on with the longest item that is left."""
    sizes = sorted(sizes, reverse=True)

    def fits(k):
        seen = set()

        def go(i, room):
            if i == len(sizes):
                return True
            if (i, room) in seen:
                return False
            seen.add((i, room))
            return any(go(i + 1, tuple(sorted([*room[:j], r - sizes[i], *room[j + 1 :]]))) for j, r in enumerate(room) if r >= sizes[i] and r not in room[:j])

        return go(0, (capacity,) * k)

    k = -(-sum(sizes) // capacity)
    while not fits(k):
        k += 1
    return k


def test_optimum_of_small_tables_that_best_fit_misses(spark):
    """One table for each instance would be slow: instances are packed by capacity-sized marks of their own lengths."""
    rng, missed = random.Random(12), 0
    for capacity in (97, 101, 113, 127, 151, 163):
        sizes = []
        for _ in range(5):
            a, b = rng.randint(capacity * 38 // 100, capacity * 49 // 100), rng.randint(capacity * 26 // 100, capacity * 34 // 100)
            sizes += [a, b, capacity - a - b]
        best = least_sequences(sizes, capacity)
        room = []
        packing.best_fit(range(15), sorted(sizes, reverse=True), [0] * 15, room, capacity)
        missed += len(room) > best
        rows = [(i, " ".join(["the"] * (n - 1)), None, None, None, None, None, None) for i, n in enumerate(sizes)]
        got = packing.pack(cases.table(spark, rows), PATH, capacity=capacity).collect()
        assert sorted(r.length for r in got) == sorted(sizes)
        assert check(rows, got, capacity) == best
    assert missed >= 3


def test_blocks_merge_what_they_leave_open(spark):
    """Many small blocks need no more sequences than a few more than one large one."""
    rng = random.Random(4)
    rows = [(i, " ".join(["the"] * rng.randint(1, 150)), None, None, None, None, None, None) for i in range(1200)]
    got = packing.pack(cases.table(spark, rows), PATH, capacity=256, block_items=40).collect()
    assert check(rows, got, 256) <= -(-sum(r.length for r in got) // 256) + 4


def test_generations_run_on_the_real_table(spark, data_dir):
    pieces = spark.read.parquet(f"{data_dir}/documents.parquet").mapInArrow(packing._pieces(PATH, 2048, 0), packing._PIECE)
    length = np.array(sorted((r.length for r in pieces.where("length < 2048").collect()), reverse=True), np.int64)
    first = packing.fresh(length, np.random.default_rng(0), 0.0, 2048)
    best, ran = packing.evolve([first], length, 1, 30, 4, 2048)
    assert ran > 0 and packing.fitness(best[0], length) <= packing.fitness(first, length)


def test_only_the_emptiest_are_opened():
    place, length = np.array([0, 0, 1, 2, 2, 3]), np.array([5, 5, 7, 4, 4, 2])
    assert packing.opened(place, length, 3, 10).tolist() == [False, True, False, True]
    assert packing.opened(place, length, 99, 10).tolist() == [False, True, True, True]
    assert not packing.opened(place, length, 0, 10).any()


@pytest.mark.parametrize("block", [4096, 64])
def test_whole_table_needs_few_sequences(spark, data_dir, block):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, PATH, block_items=block).collect()
    assert check(rows, got, 2048) <= -(-sum(r.length for r in got) // 2048) + 2


def test_evolution_finds_packings_that_best_fit_misses():
    """Sequences of three items each that fill exactly: best fit by length alone does not find them all."""
    rng = random.Random(3)
    better = 0
    for seed in range(6):
        sizes = []
        for _ in range(40):
            a = rng.randint(380, 490)
            b = rng.randint(260, 340)
            sizes += [a, b, 1000 - a - b]
        length = np.array(sorted(sizes, reverse=True), np.int64)
        first = packing.fresh(length, np.random.default_rng(seed), 0.0, 1000)
        best = packing.evolve([first], length, seed, 120, 8, 1000)[0][0]
        assert np.bincount(best, length).max() <= 1000 and len(best) == len(length)
        assert packing.fitness(best, length) <= packing.fitness(first, length)
        better += packing.fitness(best, length) < packing.fitness(first, length)
    assert better >= 4


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(2)
    length = rng.integers(1, 900, 300)
    a, b = (packing.fresh(length, rng, n, 1000) for n in (0.0, 0.5))
    for _ in range(20):
        c = packing.crossover(a, b, length, rng, 1000)
        assert (c >= 0).all() and np.bincount(c, length).max() <= 1000 and len(np.unique(c)) == c.max() + 1
        a = c


def test_a_round_goes_on_while_packings_get_better(monkeypatch):
    """In a block of full size too, as long as some of the last generations gave a better one."""
    rng, ran, evolve = np.random.default_rng(5), [], packing.evolve

    def counted(*args):
        best, n = evolve(*args)
        ran.append(n)
        return best, n

    monkeypatch.setattr(packing, "evolve", counted)
    length = np.sort(rng.integers(300, 1200, packing.BLOCK_ITEMS))[::-1].astype(np.int64)
    first = packing.fresh(length, rng, 0.0, 2048)
    state = packing._states(0, 0, np.arange(len(length)).tobytes(), length, [first], 1)
    out = packing._round(0, 1, packing.GENERATIONS, packing.POPULATION, 2048)(state).to_pylist()
    place = np.frombuffer(out[0]["packings"][0], np.int32)
    four = evolve([first], length, 0, 4, packing.POPULATION, 2048)[0][0]
    assert ran[0] >= 16 and np.bincount(place, length).max() <= 2048 and len(place) == len(length)
    assert place.max() + 1 < len(np.bincount(four))  # 1,517 after four generations


def test_evolution_ends_when_nothing_better_comes():
    length = np.full(90, 700, np.int64)  # two in each sequence, whatever is done
    first = packing.fresh(length, np.random.default_rng(0), 0.0, 1500)
    best, ran = packing.evolve([first], length, 1, None, 4, 1500, 7)
    assert ran == 7 and len(np.bincount(best[0])) == 45
