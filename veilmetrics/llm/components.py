"""Connected components by alternating large and small stars; every round is written to the shared folder.

A node's least neighbour is written before it is looked up, so that the join shuffles both sides itself and adaptive
execution can split the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, skewed_lookup


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return skewed_lookup(both, least, ["u"], name="least").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least.hint("shuffle_merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Of edges (u long, v long): node, label for each node of an edge, label the least node that it reaches."""
    edges = cut(_small_star(edges.select("u", "v").where("u <> v")), "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
