"""Connected components of an edge table by alternating large-star and small-star rounds.

Nodes and edges stay distributed; each round's edges are written to the shared folder, so a lost executor costs one round at most.
Rounds needed grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v of one orderable type. Returns (node, component) for every node with an edge; component is the smallest node reachable.

    Self-loops and repeated edges are ignored; an empty edge table gives an empty result; null ends are dropped."""
    now = materialize(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
