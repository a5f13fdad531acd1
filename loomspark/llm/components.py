"""Connected components of a graph that is too large for one machine.

Alternating large-star and small-star passes (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014). Each pass is one min-aggregation, which combines before the shuffle, and one equi-join on the same key,
which adaptive execution can split where a node has very many neighbours. No neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long) that isn't the least of its component.

    component is the least node reachable. Nodes without a row are their own component. An empty table of
    edges gives an empty table; repeated edges, loops and either direction are fine.
    """
    now = scratch.write(edges.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        after = scratch.write(_small_star(_large_star(now)), "edges")
        scratch.drop(now)
        now, state = after, _state(after)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError("components did not settle")
