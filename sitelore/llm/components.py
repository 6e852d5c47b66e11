"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, release, written


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: the least node that each node with an edge can reach.

    Alternating large and small stars: each round hangs the larger neighbours of
    a node, then the smaller ones, on its least neighbour.  The number of edges
    never grows, minima are pre-aggregated before the shuffle, and the minima of
    hubs are sent to the edges, so a hub's edges stay spread.  Each round ends in a
    written table, which replaces the one before, so a lost executor costs one
    round.  Loops and repeated edges are allowed; no edges give no rows; null ends
    are ignored.
    """
    now, size = edges.select("a", "b").where("a <> b"), edges.count()
    before = held = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hub_join(both, least, ["a"], 2 * size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "down", rows=2 * size)
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = hub_join(down, least, ["a"], 2 * size)
        now = written(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(joined.select("a", F.col("m").alias("b"))).distinct(), "edges", rows=size)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(down, held)
        held = now
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    out._scratch = now._scratch
    return out
