"""Exact dedup by a tree merge of sorted digest runs.

Each partition turns its texts into a sorted run of digests. The runs are exchanged in
rounds over a hypercube of 2 ** bits slots, fewer than twice as many as there are runs. A round
settles one to three of the bits, each round about as many, and there are at least two rounds
from four runs on: an entry moves to the slot whose bits of the round are those of its digest
and whose other bits are those of the slot it is in. So a slot receives at most ``WAYS`` runs,
merges them, and collapses equal digests to the verified best id before the next round. After
the last round a slot holds one disjoint range of digests. A group of any size reaches a slot as
one entry of each run, never as its rows.

An entry is (digest of 256 bits, length, smallest or largest id, row, rows so far). Entries
merge only if all 256 bits and the lengths agree: a shorter sort key alone decides nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifel.llm import common

DIGEST = ["d0", "d1", "d2", "d3"]
RUN = [*DIGEST, "n_bytes"]
WAYS = 8
"""Runs that meet in a slot in one round, at most."""
RUN_ROWS, LEAST_RUNS = 2_000_000, 32
"""Rows that a run should have at least, if there are more than so many runs: the number of slots follows the data, not the number of files."""
_ENTRY = "slot int, d0 long, d1 long, d2 long, d3 long, n_bytes long, id long, row long, n long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.lower() for x in common.as_bytes(b.column("text"))]  # bytes.lower() changes A-Z only
        d = np.frombuffer(b"".join(hashlib.sha256(x).digest() for x in texts), ">i8").astype(np.int64).reshape(-1, 4)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(np.ascontiguousarray(d[:, i])) for i in range(4)), pa.array(lengths)], ["doc_id", *RUN])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of a run, the first of each digest with the rows of all.
    One entry is held back from each batch, as its digest may go on in the next one."""
    held: pa.RecordBatch | None = None
    for b in batches:
        b = pa.RecordBatch.from_arrays(b.columns, b.schema.names)
        if held is not None:
            b = pa.concat_batches([held, b])
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in RUN])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        n = pa.array(np.add.reduceat(b.column("n").to_numpy(), starts))
        first = b.take(pa.array(starts))
        merged = pa.RecordBatch.from_arrays([n if c == "n" else first.column(c) for c in b.schema.names], b.schema.names)
        held = merged.slice(len(starts) - 1)
        yield merged.slice(0, len(starts) - 1)
    if held is not None:
        yield held


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, d0..d3, n_bytes, row) of every text after lower-casing A-Z; written once."""
    found = common.documents(docs).mapInArrow(common.tidy(_digests), "doc_id long, d0 long, d1 long, d2 long, d3 long, n_bytes long")
    return common.cut(found.withColumn("row", F.monotonically_increasing_id()), "digests")


def schedule(runs: int, ways: int = WAYS) -> list[int]:
    """The bits that each round settles. Together the fewest that give every run a slot; at least two rounds from four runs on."""
    bits, most = max(1, (runs - 1).bit_length()), max(1, ways.bit_length() - 1)
    rounds = max(min(2, bits), -(-bits // most))
    return [bits // rounds + (r < bits % rounds) for r in range(rounds)]


def runs_of(entries: DataFrame) -> int:
    """How many runs to begin with: the partitions, but no more than their rows need."""
    rows, parts = entries.select(F.spark_partition_id().alias("p")).agg(F.count("*"), 1 + F.coalesce(F.max("p"), F.lit(0))).first()
    return max(1, min(parts, max(LEAST_RUNS, -(-rows // RUN_ROWS))))


def tree_merge(entries: DataFrame, keep: str = "smallest", ways: int = WAYS, runs: int | None = None) -> DataFrame:
    """(d0..d3, n_bytes, id, row, n): a row for each different text. ways: runs that meet in a slot at most; runs: how many to begin with."""
    runs = runs or runs_of(entries)
    plan = schedule(runs, ways)
    slots = 1 << sum(plan)
    best = F.col("id").desc() if keep == "largest" else F.col("id")
    df = entries.coalesce(runs).select((F.spark_partition_id() % slots).alias("slot"), *RUN, F.col("doc_id").alias("id"), "row", F.lit(1).cast("long").alias("n"))
    df = df.sortWithinPartitions(*RUN, best, "row").mapInArrow(common.tidy(_merge), _ENTRY)
    done = 0
    for bits in plan:
        mask = F.lit(((1 << bits) - 1) << done)
        digit = F.shiftleft(F.pmod(F.shiftrightunsigned("d0", done), F.lit(1 << bits)).cast("int"), done)
        moved = df.withColumn("slot", (F.col("slot") - F.col("slot").bitwiseAND(mask) + digit).cast("int"))
        df = moved.repartitionById(slots, F.col("slot")).sortWithinPartitions(*RUN, best, "row").mapInArrow(common.tidy(_merge), _ENTRY)
        done += bits
    return df.drop("slot")


def exact_dedup(docs: DataFrame, keep: str = "smallest", ways: int = WAYS, runs: int | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z. Of equal texts the row with the
    smallest (or ``keep="largest"``) doc_id stays, and just one row of those that repeat it.
    A null text is the empty text; a null id is below all others and stays null.
    An empty table gives an empty result. No case of any size is dropped or capped.
    """
    rows = digests(docs)
    groups = tree_merge(rows, keep, ways, runs).select(*[F.col(c).alias(f"g_{c}") for c in RUN], F.col("id").alias("keep"), F.col("row").alias("keep_row"), F.col("n"))
    # The side of all rows may hold one digest a third of the time: a plain equi-join, whose large partitions Spark splits at run time.
    joined = rows.join(groups, [F.col(c) == F.col(f"g_{c}") for c in RUN])
    return joined.select(
        common.public_id("doc_id").alias("doc_id"),
        common.public_id("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in DIGEST])).alias("text_sha256"),
    )
