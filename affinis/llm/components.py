"""Connected components of edges in a table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of the undirected ``edges`` (a, b); label is the least node reachable.

    Each round points every node at its least neighbour, follows those pointers four steps and replaces
    both ends of each edge by what they point at. A chain shrinks to a quarter in a round and a star
    vanishes in one, so the rounds grow with the logarithm of the longest path. Minima are combined before
    they are shuffled, and each round is a written table.
    """
    edges = ws.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges0")
    labels, k = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        for _ in range(2):
            further = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = up.join(further, "up").select("node", F.col("next").alias("up"))
        up = ws.table(up, f"{name}-up{k}")
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            step = up.select(F.col("node").alias("label"), "up")
            labels = ws.table(labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")), f"{name}-labels{k}")
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where("a2 <> b2")
        edges = ws.table(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-edges{k + 1}")
        k += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
