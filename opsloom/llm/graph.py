"""Connected components by alternating large and small stars, in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Stages


def _star(edges: DataFrame, large: bool, stages: Stages, name: str) -> DataFrame:
    """Joins each node's neighbours (the larger ones, or the smaller ones) to the least node around it, as a written table."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # The least neighbour is found by partial aggregates and written before it is joined, so a node
    # with many edges is no hot group, and its edges can be split in the join.
    least = stages.write(f"{name}-least", both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = stages.write(name, moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stages.drop(f"{name}-least")
    return out


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(node, component) of every node with an edge, a written table; edges: (u, v) of bigints; component: its least node."""
    now = stages.write(f"{name}-0", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, k = None, 0
    while True:
        shape = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 30))).first()
        if shape == before or not shape[0]:
            break
        before, k = shape, k + 1
        new = _star(_star(now, True, stages, f"{name}-{k}l"), False, stages, f"{name}-{k}")
        stages.drop(f"{name}-{k - 1}", f"{name}-{k}l")
        now = new
    # In the end every edge leads to the least node of its component.
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = stages.write(name, out)
    stages.drop(f"{name}-{k}")
    return out
