"""Distributed connected components by contraction: every node hangs on its smallest smaller neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pointer jumps in a round; a chain shrinks to an eighth in each round.
JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Null ends and loops are ignored.  Each round hangs a node on its smallest smaller neighbour, shortens
    those chains, and replaces the edges by edges between the chains' ends, until none is left.  The
    smallest node of a component never has a smaller neighbour, so it is the last end to stay.
    Grouping is by the larger end only, with partial minima, so a hub is never gathered in one task.
    """
    ends = edges.where("src is not null and dst is not null and src <> dst")
    live = cut(ends.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes = live.select(F.col("u").alias("node")).union(live.select(F.col("v").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not live.isEmpty():
        up = live.groupBy("u").agg(F.min("v").alias("v"))
        for _ in range(JUMPS):
            far = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
            up = up.join(far, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        up = cut(up)
        left = up.select("u", F.col("v").alias("ru"))
        right = up.select(F.col("u").alias("v"), F.col("v").alias("rv"))
        moved = live.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b"))
        step = up.select(F.col("u").alias("component"), F.col("v").alias("root"))
        labels = labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        live = cut(moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    return labels
