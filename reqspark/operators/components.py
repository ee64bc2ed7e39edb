"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (columns a and b, longs): root is the smallest node that links lead to.

    Edges are hung alternately to the smallest neighbour of their larger end and of their smaller end, until nothing changes: about
    as many rounds as the logarithm of the longest chain, each a written table. Minima are summed up before they are shuffled,
    so that no task gathers the neighbours of one node."""
    now = written(_hung(written(edges.select("a", "b")), up=False))  # edges stand in the plan more than once, and may be dear
    state = _state(now)
    while state[0]:
        now = written(_hung(_hung(now, up=True), up=False))
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hung(edges: DataFrame, up: bool) -> DataFrame:
    """With up, the larger neighbours of each node go to the smallest of it and all its neighbours; else its smaller neighbours, and
    the node, go to the smallest of those. Pairs (a, b) with a > b."""
    pairs = edges.where("a <> b")
    if up:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", "least"))
    return moved.where("a <> b").distinct()
