"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialise

ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether all components are stars: no node has two edges down, or edges both down and up."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not roles.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down > 0 AND up > 0)").head(1)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; the minima are written first, so that a hub's edges can be split over tasks in the join."""
    if large:
        e = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialise(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "graph-minima")
    j = e.join(low, "u")
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v")
    out = materialise(out if large else out.distinct(), "graph-edges")
    discard(low, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), where root is the smallest node reachable.

    Edges lead from a node to a smaller one. Every round leaves a written edge
    table; the loop ends when each edge leads to the smallest node reachable.
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "graph-edges")
    for _ in range(ROUNDS):
        if _settled(e):
            break
        e = _star(_star(e, True), False)
    else:
        raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
    out = materialise(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct()), "components")
    discard(e)
    return out
