"""Connected components over an edge table, in DataFrame operations only.

Alternating large-star and small-star rounds: each round links every
neighbour of a node to the smallest one, so that the edges end as stars around
the smallest node of each component. Minima are aggregated before the shuffle,
hub nodes meet only in joins that adaptive execution can split, and each round
starts from a table in the shared folder, so no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here u > v in each row
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge to another; component is
    the smallest node of its component. Nulls and self-loops are left out."""
    a, b = F.col(u), F.col(v)
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds if state[0] else 0):
        after = materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(after)
        discard(now)
        now = after
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
