"""Keyed, idempotent ingest of records and conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_prefix, message_key, millis_ts, normal_ts, record_key

RECORD = "struct<text:string,id:string,session:string,ts:string,role:string>"


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """Parsed fields of NDJSON lines with ``ok``: blank lines are left out, lines
    that aren't JSON objects or have a blank text have ok = false."""
    rows = lines.withColumn("_line", F.trim(line)).where("_line <> ''")
    rows = rows.withColumn("r", F.from_json("_line", RECORD, {"mode": "PERMISSIVE"}))
    ok = F.coalesce(F.trim(F.col("r.text")) != "", F.lit(False)) & F.col("_line").startswith("{")
    return rows.withColumn("ok", ok).select(*[c for c in lines.columns if c != line], "ok", "r.text", "r.id", "r.session", "r.ts", "r.role")


def group_records(records: DataFrame, order: str, now: str) -> DataFrame:
    """Records with their session, key, ordinal, role and timestamp."""
    key = record_key(F.col("id"), F.col("text"))
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = records.withColumns({"record_key": key, "record_id": F.coalesce(blank("id"), F.lit(""))})
    rows = rows.withColumn("session", F.concat(F.lit("file:"), F.coalesce(blank("session"), blank("id"), F.col("record_key"))))
    nth = F.row_number().over(Window.partitionBy("session").orderBy(order)) - 1
    return rows.withColumns({"seq": nth, "role": F.coalesce(blank("role"), F.lit("document")), "ts": normal_ts(F.coalesce("ts", F.lit("")), F.lit(now))})


def merge_actions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records (session, record_id, record_key, text, ord) with the action
    each takes against the stored ones (session, record_id, record_key).

    skip: the key is stored, or an id-less text came before in this batch.
    update: the id is stored with another key (the first such record of a batch;
    a second edit of one id in a batch is appended, as its stored row is no longer
    the one it knew). append: anything else, so that a new id that comes twice in
    one batch is appended twice."""
    keys = stored.select("session", "record_key").distinct().withColumn("known_key", F.lit(True))
    ids = stored.where("record_id <> ''").select("session", "record_id").distinct().withColumn("known_id", F.lit(True))
    rows = incoming.join(keys, ["session", "record_key"], "left").join(ids, ["session", "record_id"], "left")
    first_key = F.row_number().over(Window.partitionBy("session", "record_key").orderBy("ord")) == 1
    fresh = F.col("known_key").isNull()
    edits = F.sum(F.when(F.col("known_id").isNotNull() & fresh, 1).otherwise(0)).over(Window.partitionBy("session", "record_id").orderBy("ord"))
    action = (
        F.when(F.col("known_key"), "skip")
        .when((F.col("record_id") == "") & ~first_key, "skip")
        .when((F.col("record_id") != "") & F.col("known_id") & (edits == 1), "update")
        .otherwise("append")
    )
    return rows.withColumn("action", action).drop("known_key", "known_id")


def merged_rows(stored: DataFrame, actions: DataFrame) -> DataFrame:
    """The stored rows after the merge: (session, record_id, record_key, text, pos)
    with updates in place and appends behind, in batch order; ``pos`` is the stored
    ordinal of old rows. Sessions with an update are rewritten whole."""
    updates = actions.where("action = 'update'").select("session", "record_id", F.col("text").alias("_text"), F.col("record_key").alias("_key"))
    nth = Window.partitionBy("session", "record_id").orderBy("pos")
    kept = stored.withColumn("_nth", F.row_number().over(nth)).join(updates, ["session", "record_id"], "left")
    hit = F.col("_text").isNotNull() & (F.col("_nth") == 1) & (F.col("record_id") != "")
    kept = kept.select("session", "record_id", F.when(hit, F.col("_key")).otherwise(F.col("record_key")).alias("record_key"), F.when(hit, F.col("_text")).otherwise(F.col("text")).alias("text"), "pos")
    tops = stored.groupBy("session").agg((F.max("pos") + 1).alias("top"))
    behind = actions.where("action = 'append'").join(tops, "session", "left")
    place = F.row_number().over(Window.partitionBy("session").orderBy("ord")) - 1 + F.coalesce("top", F.lit(0))
    return kept.unionByName(behind.select("session", "record_id", "record_key", "text", place.alias("pos")))


def reconcile(stored_keys: DataFrame, stored_counts: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Per session: unchanged, append (the stored keys are a prefix and as many rows
    are there) or replace. Inputs: (session, keys), (session, n), (session, keys)."""
    rows = new_keys.select("session", F.col("keys").alias("new")).join(stored_keys.select("session", F.col("keys").alias("old")), "session", "left").join(stored_counts, "session", "left")
    old, n = F.coalesce("old", F.array().cast("array<string>")), F.coalesce("n", F.lit(0))
    whole = n == F.size(old)
    action = F.when((F.col("new") == old) & whole, "unchanged").when(has_prefix(F.col("new"), old) & whole & (F.size(old) > 0), "append").otherwise("replace")
    return rows.select("session", action.alias("action"), F.size("new").alias("n_new"), F.size(old).alias("n_old"))


def read_turns(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns out of messages (id, session_id, time_created, data) and their parts
    (id, message_id, time_created, data): user turns, and assistant turns that are
    complete, of text parts that aren't blank, in order, joined by blank lines."""
    m = messages.select("id", "session_id", "time_created", F.get_json_object("data", "$.role").alias("role"), F.get_json_object("data", "$.time.completed").alias("completed"))
    m = m.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (F.coalesce(F.col("completed"), F.lit("0")).cast("double") != 0)))
    p = parts.select(F.col("id").alias("pid"), F.col("message_id").alias("id"), F.col("time_created").alias("ptime"), F.get_json_object("data", "$.type").alias("kind"), F.get_json_object("data", "$.text").alias("text"))
    p = p.where((F.col("kind") == "text") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    whole = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ptime", "pid", F.trim(F.col("text")).alias("text")))).alias("ps"))
    rows = m.join(whole, "id")
    ms = F.coalesce(F.when(F.col("ps")[0]["ptime"] > 0, F.col("ps")[0]["ptime"]), F.col("time_created"))
    text = F.trim(F.array_join(F.transform("ps", lambda x: x["text"]), "\n\n"))
    return rows.select(F.col("session_id").alias("session"), "time_created", F.col("id").alias("message_id"), "role", text.alias("text"), millis_ts(ms).alias("ts")).withColumn("key", message_key(F.col("message_id"), F.col("role"), F.col("text")))


def capture(events: DataFrame, now: str) -> DataFrame:
    """Raw rows out of hook events (session_id, prompt, last_assistant_message,
    effort level): a prompt is a user turn, else an assistant message an assistant
    turn; events without session or both texts are dropped."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = events.where((F.trim(F.coalesce("session_id", F.lit(""))) != "") & (has("prompt") | has("last_assistant_message")))
    user = has("prompt")
    return rows.select(
        F.col("session_id").alias("session"), F.when(user, "user").otherwise("assistant").alias("role"), F.when(user, F.col("prompt")).otherwise(F.col("last_assistant_message")).alias("text"),
        F.when(user, "").otherwise(F.coalesce("effort", F.lit(""))).alias("effort"), F.lit(now).alias("ts"),
    )


def in_sequence(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Captured rows with the seq that each takes after the turns that its session
    has, in arrival order."""
    nth = F.row_number().over(Window.partitionBy("session").orderBy("_at"))
    have = raw.groupBy("session").agg(F.count("*").alias("_have"))
    told = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_nth", nth).join(have, "session", "left")
    return told.withColumn("seq", (F.coalesce("_have", F.lit(0)) + F.col("_nth") - 1).cast("int")).drop("_at", "_nth", "_have")
