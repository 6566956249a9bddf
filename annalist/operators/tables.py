"""Changes of the engine's tables, as functions from old rows to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBSERVATION = "struct<obs_id:string,session:string,lens:string,dimension:string,observation:string,evidence:string,poignancy:int>"


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: str = "obs_id", order: str = "seq") -> DataFrame:
    """The new rows whose key isn't stored, the first of each key in order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_nth", first).where("_nth = 1").drop("_nth").join(stored.select(key), key, "left_anti")


def stage_capped(staged: DataFrame, new: DataFrame, per_session: int, total: int) -> DataFrame:
    """The new rows (session, obs_id, id in arrival order) that the stage takes:
    each (session, obs_id) once, up to a number per session and in all; a limit of
    0 or less is off. Only the global cap orders rows over sessions, and only up
    to its limit."""
    fresh = new.withColumn("_nth", F.row_number().over(Window.partitionBy("session", "obs_id").orderBy("id"))).where("_nth = 1").drop("_nth")
    fresh = fresh.join(staged.select("session", "obs_id"), ["session", "obs_id"], "left_anti")
    if per_session > 0:
        have = staged.groupBy("session").agg(F.count("*").alias("_have"))
        nth = F.row_number().over(Window.partitionBy("session").orderBy("id"))
        fresh = fresh.withColumn("_nth", nth).join(have, "session", "left").where(F.col("_nth") + F.coalesce("_have", F.lit(0)) <= per_session).drop("_nth", "_have")
    if total > 0:
        fresh = fresh.orderBy("id").limit(max(0, total - staged.count()))
    return fresh


def drain_staged(staged: DataFrame) -> DataFrame:
    """Staged rows with their parsed payload; rows that don't parse are left out."""
    rows = staged.select("id", "session", F.from_json("payload", OBSERVATION, {"mode": "PERMISSIVE"}).alias("o"))
    return rows.where("o.obs_id is not null").select("id", "session", "o.obs_id", "o.lens", "o.dimension", "o.observation", "o.evidence", "o.poignancy")


def upsert(stored: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Stored rows with new ones in place of those of the same key."""
    return stored.join(new.select(*key), [*key], "left_anti").unionByName(new)


def delete_lens(table: DataFrame, lens: str) -> DataFrame:
    return table.where(F.col("lens") != lens)


def delete_lens_meta(meta: DataFrame, lens: str) -> DataFrame:
    """Keys of a lens: exact names, and prefixes compared as they are."""
    exact = F.col("key").isin(f"review_rowid:{lens}", f"profile_sig:{lens}")
    return meta.where(~(exact | F.col("key").startswith(f"emerge_seen:{lens}:")))
