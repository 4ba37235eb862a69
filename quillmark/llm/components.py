"""Connected components of an edge table, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on edges (u > v): every node points its neighbours at the least of them. The least is a partial
    aggregate joined back, so a hub's neighbours are never gathered in one row."""
    if small:
        near = edges
    else:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    both = near.join(least, "u")
    if small:
        out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge: the least node of its component."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = materialize(now, "edges")
    for _ in range(rounds):
        after = materialize(_star(_star(now, False), True), "edges")
        # Settled when every node points at a node that points nowhere.
        if after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(after.select("v", "v").distinct())
        discard(now)
        now = after
    raise RuntimeError("components did not settle")
