"""Queries on ingest, transcripts and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import ingest, tables, text
from ..registry import query
from .bindings import obs_v, raw_v, table

_KEY = "case when trim(coalesce({id}, '')) <> '' then concat(trim({id}), ':', substr(sha256({text}), 1, 16)) else concat('h:', substr(sha256({text}), 1, 32)) end"
_STORED = f"stored as (select source as session, concat('doc-', doc_id) as record_id, {_KEY.format(id=chr(34) + 'rid' + chr(34), text='text')} as record_key, text, row_number() over (partition by source order by doc_id) - 1 as pos from (select *, concat('doc-', doc_id) as rid from documents where doc_id % 5 <> 0) q)"
_INCOMING = f"""incoming as (select source as session, rid as record_id, {_KEY.format(id='rid', text='new_text')} as record_key, new_text as text, doc_id as ord
from (select *, case when doc_id % 11 = 0 then '' else concat('doc-', doc_id) end as rid, case when doc_id % 7 = 0 then concat(text, ' v2') else text end as new_text from documents) q)"""
_MERGE = f"""{_STORED}, {_INCOMING}, told as (
  select i.*, exists (select 1 from stored s where s.session = i.session and s.record_key = i.record_key) as known_key,
    i.record_id <> '' and exists (select 1 from stored s where s.session = i.session and s.record_id = i.record_id) as known_id,
    row_number() over (partition by i.session, i.record_key order by ord) as nth from incoming i),
acts as (select *, case when known_key then 'skip' when record_id = '' and nth > 1 then 'skip' when known_id then 'update' else 'append' end as action from told)"""


def _stored(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 5 <> 0")
    rid = F.concat(F.lit("doc-"), F.col("doc_id"))
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select(F.col("source").alias("session"), rid.alias("record_id"), X.record_key(rid, F.col("text")).alias("record_key"), "text", pos.cast("long").alias("pos"))


def _incoming(spark, d):
    docs = table(spark, d, "documents")
    rid = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("doc-"), F.col("doc_id")))
    new = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    return docs.select(F.col("source").alias("session"), rid.alias("record_id"), X.record_key(rid, new).alias("record_key"), new.alias("text"), F.col("doc_id").alias("ord"))


@query("K3_merge_actions", _MERGE + " select session, ord, record_id, action from acts", views=True)
def merge_actions(spark, d):
    return ingest.merge_actions(_stored(spark, d), _incoming(spark, d)).select("session", "ord", "record_id", "action")


@query(
    "K2_K3_merged_log",
    _MERGE + """, u as (select session, record_id, record_key, text from acts where action = 'update')
select s.session, s.record_id, coalesce(u.record_key, s.record_key) as record_key, s.pos from stored s left join u on u.session = s.session and u.record_id = s.record_id
union all
select a.session, a.record_id, a.record_key, row_number() over (partition by a.session order by a.ord) - 1 + coalesce(t.top, 0) as pos
from acts a left join (select session, max(pos) + 1 as top from stored group by session) t on t.session = a.session where a.action = 'append'""",
)
def merged_log(spark, d):
    stored = _stored(spark, d)
    return ingest.merged_rows(stored, ingest.merge_actions(stored, _incoming(spark, d))).select("session", "record_id", "record_key", "pos")


@query("S1_parse_records", "select doc_id, case when doc_id % 9 in (1, 2) then false else trim(text) <> '' end as ok from documents where doc_id % 9 <> 0")
def parse_records(spark, d):
    line = F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 9 == 1, "not json").when(F.col("doc_id") % 9 == 2, '{"id":"2"}').otherwise(F.to_json(F.struct("text", F.col("doc_id").cast("string").alias("id"))))
    lines = table(spark, d, "documents").select("doc_id", line.alias("value"))
    return ingest.parse_records(lines).select("doc_id", "ok")


@query(
    "S2_normal_ts",
    """t as (select event_id, case event_id % 7 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  when 3 then strftime(ts, '%Y-%m-%d') when 4 then strftime(ts, '%m/%d/%Y') when 5 then '1754300000' else '' end as raw, ts from events)
select event_id, case when event_id % 7 in (0, 1, 2) then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when event_id % 7 = 3 then strftime(ts, '%Y-%m-%dT00:00:00Z') else 'fallback' end as ts from t""",
)
def normal_ts(spark, d):
    kind = F.col("event_id") % 7
    shown = F.lit("")
    for k, fmt in enumerate(("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")):
        shown = F.when(kind == k, F.date_format("ts", fmt)).otherwise(shown)
    shown = F.when(kind == 5, "1754300000").otherwise(shown)
    return table(spark, d, "events").select("event_id", X.normal_ts(shown, F.lit("fallback")).alias("ts"))


_GROUP_ID = "case when doc_id % 3 = 0 then '' else concat('doc-', doc_id % 50) end"


@query(
    "S3_grouped_records",
    f"""g as (select doc_id, concat('file:', case when doc_id % 2 = 0 then source when {_GROUP_ID} <> '' then {_GROUP_ID} else concat('h:', substr(sha256(text), 1, 32)) end) as session from documents)
select doc_id, session, row_number() over (partition by session order by doc_id) - 1 as seq, 'document' as role from g""",
)
def grouped(spark, d):
    docs = table(spark, d, "documents")
    rid = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("doc-"), F.col("doc_id") % 50))
    rows = docs.select("doc_id", "text", rid.alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("session"), F.lit("").alias("ts"), F.lit(" ").alias("role"))
    return ingest.group_records(rows, "doc_id", "2024-01-01T00:00:00Z").select("doc_id", "session", F.col("seq").cast("long").alias("seq"), "role")


@query("S4_record_key", f"select doc_id, {_KEY.format(id='rid', text='text')} as k from (select *, case when doc_id % 2 = 0 then concat('https://x.org/', doc_id) else '' end as rid from documents) q")
def record_keys(spark, d):
    rid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://x.org/"), F.col("doc_id"))).otherwise("")
    return table(spark, d, "documents").select("doc_id", X.record_key(rid, F.col("text")).alias("k"))


@query("S5_id_of_key", "select doc_id, case when doc_id % 2 = 0 then concat('https://x.org/', doc_id) end as id from documents")
def ids_of_keys(spark, d):
    keys = record_keys(spark, d)
    return keys.select("doc_id", X.id_of_record_key(F.col("k")).alias("id"))


@query("K4_J16_insert_or_ignore", "n as (select *, row_number() over (partition by obs_id order by seq) as nth from obs_v where seq % 4 <> 0) select seq, obs_id from n where nth = 1 and obs_id not in (select obs_id from obs_v where seq % 3 = 0)")
def insert_or_ignore(spark, d):
    obs = obs_v(spark, d)
    return tables.insert_or_ignore(obs.where("seq % 3 = 0"), obs.where("seq % 4 <> 0")).select("seq", "obs_id")


def _messages(spark, d):
    c = table(spark, d, "conversations")
    mid = F.concat(F.lit("m"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    done = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 6 == 2), 0).otherwise(1)
    m = c.select(mid.alias("id"), F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"), (F.col("turn") * 1000 + 1).alias("time_created"), F.to_json(F.struct("role", F.struct(done.alias("completed")).alias("time"))).alias("data"))
    lines = c.select(mid.alias("message_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    kind = F.when(F.col("n") % 3 == 1, "tool").otherwise("text")
    p = lines.select(F.concat("message_id", F.lit("-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("id"), "message_id", (F.col("n") + 5000).cast("long").alias("time_created"), F.to_json(F.struct(kind.alias("type"), F.col("line").alias("text"))).alias("data"))
    return m, p


@query(
    "S12_J11_X14_X26_turns",
    """with l as (select *, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from conversations
  where role = 'user' or (role = 'assistant' and conv_id % 6 <> 2)),
k as (select conv_id, turn, role, trim(line) as line, n from l where n % 3 <> 1 and trim(line) <> '')
select concat('s', conv_id) as session, concat('m', conv_id, '-', turn) as message_id, role, trim(string_agg(line, chr(10) || chr(10) order by n)) as text,
  strftime(timestamp '1970-01-01' + to_milliseconds(min(n) + 5000), '%Y-%m-%dT%H:%M:%SZ') as ts from k group by conv_id, turn, role""",
    views=False,
)
def turns(spark, d):
    return ingest.read_turns(*_messages(spark, d)).select("session", "message_id", "role", "text", "ts")


@query("X2_message_keys", "select conv_id, turn, concat('m', turn, ':', substr(sha256(concat(role, chr(0), text)), 1, 16)) as k from conversations", views=False)
def message_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.message_key(F.concat(F.lit("m"), F.col("turn")), F.col("role"), F.col("text")).alias("k"))


@query(
    "S13_U4_reconcile",
    """n as (select session, count(*) as n from raw_v group by session) select session,
  case when try_cast(substr(session, 6) as int) % 3 = 0 then 'unchanged' when try_cast(substr(session, 6) as int) % 3 = 1 and n > 1 then 'append' else 'replace' end as action from n""",
)
def reconcile(spark, d):
    keys = raw_v(spark, d).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.sha1("text").alias("k")))), lambda x: x["k"]).alias("keys"))
    kind = F.substring("session", 6, 20).cast("int") % 3
    old = keys.select("session", F.when(kind == 0, F.col("keys")).when(kind == 1, F.slice("keys", 1, F.size("keys") - 1)).otherwise(F.transform("keys", lambda x: F.concat(x, F.lit("!")))).alias("keys"))
    return ingest.reconcile(old, old.select("session", F.size("keys").alias("n")), keys).select("session", "action")


@query("S15_captured", "select concat('s', user_id) as session, case when event_id % 3 = 0 then 'user' else 'assistant' end as role, case when event_id % 3 = 0 then props else concat(event_type, '#', event_id) end as text from events where event_id % 3 <> 2", views=False)
def captured(spark, d):
    kind = F.col("event_id") % 3
    events = table(spark, d, "events").select(
        F.when(kind == 2, "").otherwise(F.concat(F.lit("s"), F.col("user_id"))).alias("session_id"), F.when(kind == 0, F.col("props")).alias("prompt"),
        F.concat("event_type", F.lit("#"), F.col("event_id")).alias("last_assistant_message"), F.lit("high").alias("effort"),
    )
    return ingest.capture(events, "2024-01-01T00:00:00Z").select("session", "role", "text")


@query("X6_transcripts", "select session, string_agg(concat(upper(role), ': ', text, chr(10), chr(10)), '' order by id) as transcript from raw_v group by session")
def transcripts(spark, d):
    return text.transcripts(raw_v(spark, d))


@query("X7_fenced", "select id, concat('<<<the:of', chr(10), regexp_replace(replace(text, ' ', ':'), '(the):(of)', '\\1_\\2', 'gi'), chr(10), 'the:of>>>') as fenced from raw_v")
def fenced(spark, d):
    return raw_v(spark, d).select("id", X.fenced(F.replace("text", F.lit(" "), F.lit(":")), "the:of").alias("fenced"))


@query("W4_chunks")
def chunked(spark, d):
    return text.chunks(raw_v(spark, d), 2000)


@query("X1_obs_ids", "select seq, concat('obs_', substr(sha1(concat(session, '|', lens, '|', observation)), 1, 12)) as k from obs_v")
def obs_ids(spark, d):
    return obs_v(spark, d).select("seq", X.obs_id(F.col("session"), F.col("lens"), F.col("observation")).alias("k"))


@query("X9_rendered_hits", "select seq, concat('- [', ts, ' · ', dimension, '] ', observation, chr(10), case when evidence <> '' then concat('  evidence: ', evidence, chr(10)) else '' end, '  id: ', obs_id, chr(10)) as line from obs_v")
def rendered_hits(spark, d):
    return obs_v(spark, d).select("seq", text.hit_line(F.col("ts"), F.col("dimension"), F.col("observation"), F.col("evidence"), F.col("obs_id")).alias("line"))


@query("X10_short_dates", "select id, substr(ts, 1, 10) as day from raw_v")
def short_dates(spark, d):
    return raw_v(spark, d).select("id", X.short_date(F.col("ts")).alias("day"))


@query("X14_millis", "select event_id, case when event_id % 5 = 0 then '' else strftime(timestamp '1970-01-01' + to_milliseconds(event_id * 86400123), '%Y-%m-%dT%H:%M:%SZ') end as ts from events", views=False)
def millis(spark, d):
    return table(spark, d, "events").select("event_id", X.millis_ts(F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") * 86400123)).alias("ts"))


@query("X19_clamped", "select event_id, greatest(0.0, least(1.0, value / 50 - 0.5)) as x from events", views=False)
def clamped(spark, d):
    return table(spark, d, "events").select("event_id", X.clamp01(F.col("value") / 50 - 0.5).alias("x"))


@query("F10_record_limits", "select doc_id, octet_length(encode(text)) > 2000 as too_long, case when n_chars < 1 then 5 when n_chars > 10 then 10 else n_chars end as poignancy, regexp_replace(trim(concat(' ', source, '/', lang, ' ')), '[^A-Za-z0-9_-]', '_', 'g') as lens from documents", views=False)
def record_limits(spark, d):
    docs = table(spark, d, "documents")
    poignancy = F.when(F.col("n_chars") < 1, 5).when(F.col("n_chars") > 10, 10).otherwise(F.col("n_chars"))
    return docs.select("doc_id", X.too_long(F.col("text"), X.LIMITS["observation"]).alias("too_long"), poignancy.cast("long").alias("poignancy"), X.safe_name(F.concat(F.lit(" "), "source", F.lit("/"), "lang", F.lit(" "))).alias("lens"))


@query("F8_null_safe", "select id, session from raw_v where nullif(effort, '') is distinct from 'scratch'")
def null_safe(spark, d):
    return raw_v(spark, d).where(~F.nullif(F.col("effort"), F.lit("")).eqNullSafe(F.lit("scratch"))).select("id", "session")


@query("F12_safe_names", "select page_id, regexp_replace(coalesce(nullif(trim(url), ''), 'unknown'), '[^A-Za-z0-9_-]', '_', 'g') as name, false as reserved from pages", views=False)
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"), X.reserved_name(F.col("url")).alias("reserved"))


@query("F14_empty_archive", "select count(*) = 0 as empty from raw_v")
def empty_archive(spark, d):
    return raw_v(spark, d).agg((F.count("*") == 0).alias("empty"))


@query("U2_merged_ids", "select conv_id, string_agg(role, ',' order by first) as ids from (select conv_id, role, min(turn) as first from conversations group by conv_id, role) q group by conv_id", views=False)
def merged_ids(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return rows.select("conv_id", F.array_join(X.merged_ids(F.slice("r", 1, 1), F.concat(F.array(F.lit("")), F.col("r"))), ",").alias("ids"))


@query("S1_3_platforms", "select id, case when id % 3 = 0 then 'opencode' when id % 3 = 1 then 'file' else 'claude' end as platform from raw_v")
def platforms(spark, d):
    kind = F.col("id") % 3
    session = F.when(kind == 0, F.concat(F.lit("opencode:"), "session")).when(kind == 1, F.concat(F.lit("file:"), "session")).otherwise(F.col("session"))
    return raw_v(spark, d).select("id", X.platform_of(session, F.when(F.col("id") % 2 == 0, "unknown")).alias("platform"))


@query("X8_valid_text", "select doc_id, text from documents", views=False)
def valid_text(spark, d):
    from ..operators.models import sanitised

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(sanitised("text"), "doc_id long, text string")


@query("Q2_Q5_X23_mined")
def mined(spark, d):
    from ..operators.models import echo_miner, mine

    return mine(text.chunks(raw_v(spark, d), 0), echo_miner, "default")


#: At 87 bytes; of a character that they cut in two, a replacement is left.
_CUT = "case when strlen(t) <= 88 then t else substr(t, 1, k) || case when strlen(substr(t, 1, k)) < 87 then chr(65533) else '' end || '…' end"


@query(
    "O9_previews",
    f"""first as (select dimension, seq, trim(observation) as t, row_number() over (partition by dimension order by seq) as nth from obs_v),
cut as (select *, list_max(list_filter(range(0, 88), lambda x: strlen(substr(t, 1, x)) <= 87)) as k from first where nth <= 5)
select dimension, string_agg({_CUT}, chr(10) order by seq) as preview from cut group by dimension""",
)
def previews(spark, d):
    first = obs_v(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("dimension").orderBy("seq"))).where("nth <= 5")
    rows = first.groupBy("dimension").agg(F.array_sort(F.collect_list(F.struct("seq", X.preview(F.col("observation")).alias("t")))).alias("ts"))
    return rows.select("dimension", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("preview"))


@query("X5_transcript_digests", """select session, sha256('[' || string_agg('{"role":' || cast(to_json(role) as varchar) || ',"text":' || cast(to_json(text) as varchar) || '}', ',' order by id) || ']') as digest from raw_v group by session""")
def digests(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("id", "role", "text")))
    return raw_v(spark, d).groupBy("session").agg(turns.alias("t")).select("session", X.transcript_digest(F.col("t")).alias("digest"))


@query("X13_readable_ts", "select id, strftime(try_cast(nullif(ts, '') as timestamp), '%Y-%m-%d %H:%M:%S') as ts from raw_v")
def readable(spark, d):
    return raw_v(spark, d).select("id", F.date_format(X.parsed_ts(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("K15_lens_dropped", "select seq from obs_v where lens <> 'math'")
def lens_dropped(spark, d):
    return tables.delete_lens(obs_v(spark, d), "math").select("seq")


@query("K10_watermark_upsert", "select session, lens, case when retries > 0 then 7 else distilled end as distilled from progress_v")
def watermark_upsert(spark, d):
    from .bindings import progress_v

    old = progress_v(spark, d)
    new = old.where("retries > 0").withColumn("distilled", F.lit(7))
    return tables.upsert(old, new, "session", "lens").select("session", "lens", "distilled")
