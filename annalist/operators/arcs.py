"""Emergent patterns: candidate arcs, their coverage and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import arc_signature
from .vectors import embedded, persistent_groups, reexpand


def describe_arcs(members: DataFrame, arc: str = "arc") -> DataFrame:
    """Per arc: n, sessions, days, span and poignancy of (arc, observation) rows."""
    there = F.when(F.col("ts") != "", F.col("ts"))
    return members.groupBy(arc).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("session")).alias("sessions"), F.countDistinct(F.substring(there, 1, 10)).alias("days"),
        F.coalesce(F.min(there), F.lit("")).alias("span_from"), F.coalesce(F.max(there), F.lit("")).alias("span_to"), F.sum("poignancy").alias("poignancy"),
        F.array_sort(F.collect_list("obs_id")).alias("ids"),
    )


def coverage(members: DataFrame, citations: DataFrame, arc: str = "arc") -> DataFrame:
    """arc, coverage, facet: the largest share of an arc's members that one facet
    cites in any of its versions; ties go to the first facet in order.
    citations: lens, dimension, key, obs_id."""
    sizes = members.groupBy(arc).agg(F.countDistinct("obs_id").alias("size"))
    cited = members.select(arc, "obs_id").distinct().join(citations.select("lens", "dimension", "key", "obs_id").distinct(), "obs_id")
    counts = cited.groupBy(arc, "lens", "dimension", "key").agg(F.count("*").alias("hits"))
    best = Window.partitionBy(arc).orderBy(F.desc("hits"), "lens", "dimension", "key")
    top = counts.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    out = sizes.join(top, arc, "left")
    return out.select(arc, F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0)).alias("coverage"), F.coalesce(F.concat("dimension", F.lit("|"), "key"), F.lit("")).alias("facet"))


def candidates(obs: DataFrame, citations: DataFrame, lens: str) -> DataFrame:
    """Arcs of a lens, described: persistent groups, widened around
    their centroids, of two sessions at least, each set of members once."""
    own = embedded(obs, lens)
    groups = persistent_groups(own, obs.count()).select(F.col("node").alias("seq"), F.col("component").alias("arc"))
    members = reexpand(groups.join(own, "seq"), own, "arc").join(own.drop("embedding"), "seq")
    arcs = describe_arcs(members).where(F.size("sessions") >= 2)
    arcs = arcs.withColumn("signature", arc_signature(F.lit(lens), F.col("ids")))
    once = Window.partitionBy("signature").orderBy("arc")
    arcs = arcs.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").drop("_nth")
    return arcs.join(coverage(members, citations), "arc")


def salience() -> list:
    """The order of arcs: least covered, most sessions, weightiest, largest first."""
    return [F.asc("coverage"), F.desc(F.size("sessions")), F.desc("poignancy"), F.desc("n"), F.asc("arc")]


def to_verify(arcs: DataFrame, seen: DataFrame, budget: int) -> DataFrame:
    """The first arcs by rank that weren't judged before with as many members;
    those skipped as seen take none of the budget. seen: signature, members."""
    fresh = arcs.join(seen.select("signature", F.col("members").alias("n")), ["signature", "n"], "left_anti")
    return fresh.orderBy(*salience()).limit(budget)
