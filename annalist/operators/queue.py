"""The incremental work queue: what is pending for which lens, and how far it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import parsed_ts, ready


def lens_frame(spark: SparkSession, lenses: Sequence[str]) -> DataFrame:
    """The active lenses as rows; they are given as parameters, so they are few."""
    rows = ", ".join("('" + x.replace("\\", "\\\\").replace("'", "\\'") + "')" for x in lenses)
    return spark.sql(f"select * from values {rows} as t(lens)") if lenses else spark.sql("select '' as lens where false")


def session_totals(raw: DataFrame) -> DataFrame:
    """Rows, latest ts, generation and characters of each session."""
    return raw.groupBy("session").agg(
        F.count("*").alias("n"), F.coalesce(F.max("ts"), F.lit("")).alias("last_ts"), F.max("id").alias("max_id"),
        F.sum(F.length("text")).alias("chars"), F.max(parsed_ts(F.col("ts"))).alias("updated_at"),
    )


def pending_sessions(raw: DataFrame, staged: DataFrame, progress: DataFrame, lenses: Sequence[str], now: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sessions with turns beyond a lens's watermark, or with staged observations,
    for a lens that isn't backed off. With a range, only sessions whose latest
    readable timestamp lies in it; sessions that are only staged have none."""
    spark = raw.sparkSession
    if not lenses:
        return spark.sql("select '' as session where false")
    active = F.broadcast(lens_frame(spark, lenses))
    totals = session_totals(raw).select("session", "n", "updated_at")
    state = progress.select("session", "lens", "distilled", "next_attempt")
    behind = totals.crossJoin(active).join(state, ["session", "lens"], "left").where((F.col("n") > F.coalesce("distilled", F.lit(0))) & ready(F.col("next_attempt"), F.lit(now)))
    waiting = staged.select("session").distinct().crossJoin(active).join(state, ["session", "lens"], "left").where(ready(F.col("next_attempt"), F.lit(now)))
    found = behind.select("session").unionByName(waiting.select("session")).distinct()
    if since is not None or until is not None:
        found = found.join(totals.select("session", "updated_at"), "session", "left")
        if since is not None:
            found = found.where(F.col("updated_at") >= parsed_ts(F.lit(since)))
        if until is not None:
            found = found.where(F.col("updated_at") <= parsed_ts(F.lit(until)))
    return found.select("session")


def next_backoff(progress: DataFrame, lenses: Sequence[str], now: str) -> DataFrame:
    """One row: when the soonest backoff of an active lens ends, null if none runs."""
    return progress.where(F.col("lens").isin(*lenses) & (parsed_ts(F.col("next_attempt")) > parsed_ts(F.lit(now)))).agg(F.min("next_attempt").alias("next_attempt"))


def pending_chars(raw: DataFrame, progress: DataFrame, lenses: Sequence[str]) -> DataFrame:
    """session, chars past the least watermark of the active lenses (0 for a lens
    without progress)."""
    active = F.broadcast(lens_frame(raw.sparkSession, lenses))
    sessions = raw.select("session").distinct()
    done = sessions.crossJoin(active).join(progress.select("session", "lens", "distilled"), ["session", "lens"], "left")
    least = done.groupBy("session").agg(F.min(F.coalesce("distilled", F.lit(0))).alias("done"))
    nth = raw.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("id")))
    past = nth.join(least, "session").groupBy("session").agg(F.sum(F.when(F.col("nth") > F.col("done"), F.length("text")).otherwise(0)).alias("chars"))
    return past


def lens_tail(raw: DataFrame, progress: DataFrame, lenses: Sequence[str]) -> DataFrame:
    """The turns that each lens has still to read, in order."""
    active = F.broadcast(lens_frame(raw.sparkSession, lenses))
    nth = raw.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("id")))
    state = progress.select("session", "lens", "distilled")
    return nth.crossJoin(active).join(state, ["session", "lens"], "left").where(F.col("nth") > F.coalesce("distilled", F.lit(0)))


def last_distilled_ts(raw: DataFrame, progress: DataFrame) -> DataFrame:
    """The latest ts among the turns that some lens has read, by seq."""
    most = progress.groupBy("session").agg(F.max("distilled").alias("distilled"))
    return raw.join(most, "session").where("seq < distilled").groupBy("session").agg(F.max("ts").alias("last_ts"))


def stats(raw: DataFrame, obs: DataFrame, facets: DataFrame, progress: DataFrame, staged: DataFrame, lenses: Sequence[str], now: str) -> DataFrame:
    """One row of health figures; each table is aggregated once."""
    r = raw.agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("raw_records"))
    o = obs.agg(F.count("*").alias("observations"))
    f = facets.agg(F.count("*").alias("facets"))
    p = pending_sessions(raw, staged, progress, lenses, now).agg(F.count("*").alias("pending"))
    active = progress.where(F.col("lens").isin(*lenses))
    b = active.agg(
        F.count(F.when(parsed_ts(F.col("next_attempt")) > parsed_ts(F.lit(now)), 1)).alias("backed_off"),
        F.count(F.when(F.col("drift_at") != "", 1)).alias("drifted"),
    )
    out = r
    for x in (o, f, p, b):
        out = out.crossJoin(F.broadcast(x))
    return out


def retries_after_failure(progress: DataFrame, failed: DataFrame, now: str) -> DataFrame:
    """Progress with one more retry and the next attempt for failed (session, lens) pairs."""
    from ..functions.scalars import RFC3339, backoff_minutes

    hit = progress.join(failed.select("session", "lens").distinct().withColumn("_failed", F.lit(True)), ["session", "lens"], "full_outer")
    retries = F.coalesce("retries", F.lit(0)) + F.when(F.col("_failed"), 1).otherwise(0)
    later = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) + backoff_minutes(retries) * 60), RFC3339)
    return hit.select(
        "session", "lens", F.coalesce("distilled", F.lit(0)).alias("distilled"), retries.alias("retries"), F.coalesce("distilled_at", F.lit("")).alias("distilled_at"),
        F.when(F.col("_failed"), later).otherwise(F.coalesce("next_attempt", F.lit(""))).alias("next_attempt"), F.coalesce("drift_at", F.lit("")).alias("drift_at"),
    )


def commit_watermarks(progress: DataFrame, raw: DataFrame, marks: DataFrame, now: str) -> DataFrame:
    """Compare-and-set: marks (session, lens, distilled, raw_high_id) apply only if
    the raw row of their generation is still there, or the generation is 0 and the
    session has no rows. Applied marks clear retries, backoff and drift, but for those
    whose optional column ``drifted`` is true: they are stamped with ``now``."""
    if "drifted" not in marks.columns:
        marks = marks.withColumn("drifted", F.lit(False))
    alive = marks.join(raw.select(F.col("session"), F.col("id").alias("raw_high_id")), ["session", "raw_high_id"], "left_semi")
    empty = marks.where("raw_high_id = 0").join(raw.select("session"), "session", "left_anti")
    won = alive.unionByName(empty.select(*alive.columns)).select("session", "lens", "distilled", "drifted")
    fresh = won.select("session", "lens", "distilled", F.lit(0).alias("retries"), F.lit(now).alias("distilled_at"), F.lit("").alias("next_attempt"), F.when(F.col("drifted"), now).otherwise("").alias("drift_at"))
    return progress.join(won, ["session", "lens"], "left_anti").select(*fresh.columns).unionByName(fresh)


def prune_before(raw: DataFrame, cutoff: str) -> DataFrame:
    """Sessions whose latest ts (as text) is before the cutoff; one without any
    timestamp is, too."""
    return raw.groupBy("session").agg(F.max("ts").alias("last_ts"), F.count("*").alias("n")).where(F.col("last_ts") < cutoff)
