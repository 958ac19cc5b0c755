"""Connected components by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a").where("b > a").select(F.col("b"), F.col("m").alias("a"))
    return out.where("a < b").select("a", "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a < b; every b keeps its smallest a, and its other neighbours join that."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).where("a < b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every
    node that has an edge.  Rounds grow with the logarithm of the largest component.
    A star's hub is only ever the key of a combined minimum and of a join whose large
    partitions adaptive execution splits, so no task needs a component whole."""
    now = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())

    at = mark(now)
    for _ in range(max_rounds):
        if not at[0]:
            break
        nxt = stash(_small_star(_large_star(now).distinct()).distinct(), "stars")
        was, at = at, mark(nxt)
        drop(now)
        now = nxt
        if at == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
