"""Mixing sources to target weights by entropy balancing.

Document i of source s is taken at the rate w_i = min(cap, exp(lambda_s * x_i)), x_i being
its size over the mean size of the source. These rates are the closest ones to "every
document once" in relative entropy among all with sum_i w_i * size_i = target_s and
w_i <= cap; lambda solves the convex dual. Newton's steps for all sources at once are
distributed sums over a table of (source, size, documents of that size).

Rates become copies by error diffusion: documents of a source are dealt to blocks by a hash
of their id, and inside a block, from the longest on, each takes the copies that bring the
words taken so far closest to the words due so far. Short documents thus make up for what
long ones could not, and a block ends within about the size of its shortest documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifel.llm import common

MAX_SOURCES = 100_000
"""Sources whose totals the driver may hold; more raise an error, none is dropped."""
BLOCK_ROWS = 2_000
"""Documents of a source that are rounded together."""


def _sizes(more: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", *more]
        for b in batches:
            sizes = np.fromiter((len(x.split()) for x in common.as_bytes(b.column("text"))), np.int64, b.num_rows)  # of bytes: splits at [\x20\x09-\x0D]+
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sizes)], [*names, "size"])

    return run


def targets(totals: list[tuple[str | None, int]], share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1)) -> list[float]:
    """For (source, size) in any order the target of each, in that order: share of all sizes by
    weights that repeat over the sources by code point (null last), none above cap times its
    size, the excess shared again by weight."""
    order = sorted(range(len(totals)), key=lambda i: (totals[i][0] is None, (totals[i][0] or "").encode("utf-8")))
    weight = [0.0] * len(totals)
    for place, i in enumerate(order):
        weight[i] = weights[place % len(weights)]
    out, left, open_ = [0.0] * len(totals), share * sum(n for _, n in totals), order
    while open_:
        whole = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / whole >= cap * totals[i][1]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / whole
            break
        for i in full:
            out[i] = float(cap * totals[i][1])
        left = max(0.0, left - sum(out[i] for i in full))
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.exp(F.least(lam * x, F.lit(math.log(cap))))


def solve(histogram: DataFrame, state: list[dict], cap: float, rounds: int = 200, within: float = 1e-7) -> dict[int, float]:
    """lambda of each source. histogram: (sid, size, n); state: sid, total, mean, target, smallest.
    A Newton step that leaves the interval known to hold the root is replaced by its middle. Sources
    that miss their target by more than ``within`` of it after all rounds are an error."""
    spark = histogram.sparkSession
    low, high, lam, open_ = {}, {}, {}, set()
    for s in state:
        if s["total"] <= 0 or s["target"] >= cap * s["total"] * (1 - 1e-12):
            lam[s["sid"]] = math.inf if s["total"] > 0 else 0.0
            continue
        low[s["sid"]], high[s["sid"]] = -math.inf, math.log(cap) * s["mean"] / max(1, s["smallest"])
        lam[s["sid"]] = 0.0
        open_.add(s["sid"])
    by = {s["sid"]: s for s in state}
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(k, lam[k], float(by[k]["mean"])) for k in sorted(open_)], "k int, lam double, mean double")  # MAX_SOURCES rows at most
        x = F.col("size") / F.col("mean")
        w = _rate(F.col("lam"), x, cap)
        tokens = F.col("n") * F.col("size")
        slope = F.when(F.col("lam") * x < math.log(cap), tokens * w * x).otherwise(0.0)
        sums = histogram.join(F.broadcast(now), F.col("sid") == F.col("k")).groupBy("sid").agg(F.sum(tokens * w).alias("taken"), F.sum(slope).alias("slope")).collect()
        for r in sums:
            k, target = r["sid"], by[r["sid"]]["target"]
            gap = r["taken"] - target
            if abs(gap) <= within * max(1.0, target):
                open_.discard(k)
                continue
            if gap > 0:
                high[k] = lam[k]
            else:
                low[k] = lam[k]
            step = lam[k] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not low[k] < step < high[k]:
                step = (low[k] + high[k]) / 2 if low[k] > -math.inf else min(2 * high[k], lam[k] * 2) - 1
            lam[k] = step
    if open_:
        raise RuntimeError(f"{len(open_)} sources did not reach their target in {rounds} rounds")
    return lam


def _diffuse(cap: int):
    """Copies for rows in the order (sid, block, size descending, doc_id): one pass, a few numbers of state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, due = None, 0.0
        for b in batches:
            sids, blocks = b.column("sid").to_pylist(), b.column("block").to_pylist()
            sizes, rates = b.column("size").to_pylist(), b.column("rate").to_pylist()
            copies = []
            for key, size, rate in zip(zip(sids, blocks, strict=True), sizes, rates, strict=True):
                if key != at:
                    at, due = key, 0.0
                if not size:
                    copies.append(min(cap, int(rate + 0.5)))
                    continue
                due += rate * size
                n = min(cap, max(0, math.floor(due / size + 0.5)))
                due -= n * size
                copies.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sid"), b.column("size"), pa.array(copies, pa.int64()), b.column("row")], ["doc_id", "sid", "size", "copies", "row"])

    return run


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[float, ...] = (5, 2, 1), block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken, row, and the columns of ``carry``.

    size: runs of ``[^\\x20\\x09-\\x0D]`` in the text, 0 if null. source_size: the sum of its
    source's; target: the words that its source is to give; copies: 0 to cap; taken:
    copies * size. A null source is a source of its own, the last in order. Documents of
    size 0 are taken at the rate 1 and change no sum. Rows that repeat a doc_id are
    documents like others. Reruns agree: the blocks and orders follow from ids and sizes.
    An empty table gives an empty result. ``row`` numbers the rows of the result.
    """
    spark = docs.sparkSession
    handed = [F.col(f"`{c}`").alias(f"c_{c}") for c in carry]
    common.bound_batches(spark)
    base = docs.select(common.internal_id("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), *handed)
    kind, names = dict(base.dtypes), [f"c_{c}" for c in carry]
    schema = ", ".join(["doc_id long", "source string", *(f"`{c}` {kind[c]}" for c in names), "size long"])
    sized = common.cut(base.mapInArrow(common.tidy(_sizes(names)), schema).withColumn("row", F.monotonically_increasing_id()), "sizes")
    per_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = per_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; map them to fewer first")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    goal = targets([(r["source"], r["total"]) for r in totals], share, cap, weights)
    state = [{"sid": i, "total": r["total"], "mean": r["total"] / max(1, r["docs"]) or 1.0, "target": goal[i], "smallest": r["smallest"] or 1} for i, r in enumerate(totals)]
    dim = spark.createDataFrame([(i, r["source"], r["total"], goal[i], max(1, -(-r["docs"] // block_rows))) for i, r in enumerate(totals)], "sid int, s_source string, source_size long, target double, blocks long")
    named = lambda df: df.join(F.broadcast(dim), F.col("source").eqNullSafe(F.col("s_source")))  # noqa: E731  dim: MAX_SOURCES rows at most
    histogram = common.cut(named(per_size).select("sid", "size", "n"), "size-histogram")
    lam = solve(histogram, state, cap)
    tilt = spark.createDataFrame([(s["sid"], min(lam[s["sid"]], 1e300), float(s["mean"])) for s in state], "t_sid int, lam double, mean double")
    rate = F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size") / F.col("mean"), cap)).otherwise(1.0)
    due = named(sized).join(F.broadcast(tilt), F.col("sid") == F.col("t_sid")).select("doc_id", "sid", "size", "row", rate.alias("rate"), F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = due.repartition(parts, "sid", "block").sortWithinPartitions("sid", "block", F.col("size").desc(), "doc_id", "row")
    taken = dealt.mapInArrow(common.tidy(_diffuse(cap)), "doc_id long, sid int, size long, copies long, row long")
    done = taken.join(F.broadcast(dim), "sid")
    if carry:
        done = done.join(sized.select(F.col("row").alias("c_row"), *names), F.col("row") == F.col("c_row"))
    return done.select(
        common.public_id("doc_id").alias("doc_id"), F.col("s_source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row", *(F.col(f"c_{c}").alias(c) for c in carry)
    )
