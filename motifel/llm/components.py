"""Connected components of links by randomised contraction, without a driver-side graph.

A round gives every vertex a new random priority, lets it choose the vertex of the least
priority among all that are at most two links away, and puts the choice in its place in all
links. Stars and cliques are done in one round; whatever the ids and their order, a chain keeps a
third of its vertices, so the rounds are logarithmic and all of them together move a small
multiple of the links. The choices are put together from the last round to the first.

Every table of a round is written to the shared folder, so none depends on the executors
that made the one before. A vertex with a large share of all links, or a component with a
large share of all vertices, is looked up by ``hot_lookup`` and so meets no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifel.llm import common

HOT_SHARE = 1024
"""A key is hot with more than this fraction of all rows; so there are never more than so many hot keys."""


def hot_lookup(rows: DataFrame, key: Column, n_rows: int, table: DataFrame, hot: DataFrame, out: str) -> DataFrame:
    """rows with the value that table (k, value), unique in k, has for key, or null, as ``out``.

    hot: the keys k that may have more than n_rows / HOT_SHARE rows, fewer than HOT_SHARE by
    that definition: their values go to all workers. Other rows meet their key in a shuffle;
    hot ones are dealt there by their own content, as they need nothing from it.
    """
    if n_rows == 0:
        return rows.withColumn(out, F.lit(None).cast("long"))
    keys = hot.select(F.col("k").alias("__h"))
    theirs = table.join(F.broadcast(keys), F.col("k") == F.col("__h"), "left_semi").select("k", F.col("value").alias("__hv"))
    few = keys.join(F.broadcast(theirs), F.col("__h") == F.col("k"), "left").select("__h", "__hv")  # also those that the table does not have
    marked = rows.withColumn("__key", key).join(F.broadcast(few), F.col("__key") == F.col("__h"), "left")
    dealt = marked.withColumn("__key", F.when(F.col("__h").isNull(), F.col("__key")).otherwise(F.xxhash64(*[F.col(c) for c in rows.columns])))
    found = dealt.join(table.select(F.col("k").alias("__k"), F.col("value").alias("__v")), F.col("__key") == F.col("__k"), "left")
    return found.select(*rows.columns, F.when(F.col("__h").isNull(), F.col("__v")).otherwise(F.col("__hv")).alias(out))


def hot_keys(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """(k): the keys with more than n_rows / HOT_SHARE of the n_rows rows."""
    return rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > n_rows).select("k")


def contract(links: DataFrame) -> list[DataFrame]:
    """For each round the written table (k, value): each vertex that still had links, and its choice.
    A choice names a vertex of the next round, which has all links of those that chose it; the vertex of
    that name in this round may have chosen another."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    edges, maps = common.cut(both, "links"), []
    while n := edges.count():
        priority = lambda c: F.xxhash64(F.col(c), F.lit(len(maps)))  # noqa: B023, E731
        least = edges.groupBy("a").agg(F.min_by("b", priority("b")).alias("near"), F.count("*").alias("n"))
        first = F.when(priority("near") < priority("a"), F.col("near")).otherwise(F.col("a"))
        near = common.cut(least.select(F.col("a").alias("k"), first.alias("value"), "n"), "near")
        hot = common.cut(near.where(F.col("n") * HOT_SHARE > n).select("k"), "hot")
        seen = hot_lookup(edges, F.col("b"), n, near, hot, "x").select("a", "x").union(near.select("k", "value"))
        chosen = common.cut(seen.groupBy(F.col("a").alias("k")).agg(F.min_by("x", priority("x")).alias("value")), "chosen")
        half = hot_lookup(edges, F.col("a"), n, chosen, hot, "x").select(F.col("x").alias("a"), "b").distinct()
        whole = hot_lookup(half, F.col("b"), n, chosen, hot, "x").select("a", F.col("x").alias("b")).where(F.col("a") != F.col("b")).distinct()
        maps.append(chosen)
        edges = common.cut(whole, "links")
    return maps


def groups(links: DataFrame) -> DataFrame:
    """(v, comp): each end of a link (a, b), a <> b, with one member of its component, the same for
    all of it. Links are undirected, may repeat, and have no null ends. No links give no rows."""
    maps = contract(links)
    if not maps:
        return links.select(F.col("a").alias("v"), F.col("a").alias("comp")).where(F.lit(False))
    placed = maps[-1]
    for m in reversed(maps[:-1]):
        n = m.count()
        later = hot_lookup(m, F.col("value"), n, placed, hot_keys(m, "value", n), "top")
        placed = common.cut(later.select("k", F.coalesce("top", "value").alias("value")), "placed")
    return placed.select(F.col("k").alias("v"), F.col("value").alias("comp"))


def components(links: DataFrame) -> DataFrame:
    """(v, comp): each end of a link (a, b), a <> b, with the smallest id that links reach. Otherwise as ``groups``."""
    placed = common.cut(groups(links), "groups")
    n = placed.count()
    least = placed.groupBy(F.col("comp").alias("k")).agg(F.min("v").alias("value"))
    return hot_lookup(placed, F.col("comp"), n, least, hot_keys(placed, "comp", n), "least").select("v", F.col("least").alias("comp"))
