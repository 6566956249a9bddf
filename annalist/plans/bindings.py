"""The engine's tables over the supplied ones: each view in Spark and in DuckDB.

Ids of turns follow from (conv_id, turn), so that no global order is needed.

``raw_v`` (L0) holds conversation turns, ``obs_v`` (L1) observations with real
vectors, ``progress_v`` the queue state, ``assert_v`` facet assertions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-04-01T00:00:00Z"

_DUCK_TS = "strftime(timestamp '2024-01-01' + to_days(cast({d} as int)) + to_minutes({m}), '%Y-%m-%dT%H:%M:%SZ')"
_SPARK_TS = "date_format(timestamp '2024-01-01 00:00:00' + make_dt_interval(cast({d} as int), 0, cast({m} as int), 0), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

_RAW = """
select cast(conv_id * 1048576 + turn + 1 as bigint) as id, concat('conv:', conv_id) as session, cast(turn as int) as seq,
       case when conv_id % 13 = 5 then '' else {ts_raw} end as ts, role, '' as effort, text
from conversations
"""
_OBS = """
select seq, concat('obs_', substr({sha1}(concat(session, '|', lens, '|', observation)), 1, 12)) as obs_id, ts, session, lens,
       dimension, observation, evidence, poignancy, source, embedding
from (select e.vec_id + 1 as seq, {ts_obs} as ts, concat('conv:', e.vec_id % 23) as session,
             case when e.vec_id % 3 = 0 then 'math' else 'default' end as lens, concat('dim', e.label % 8) as dimension,
             concat(coalesce(d.text, ''), '#', e.vec_id) as observation, coalesce(d.source, '') as evidence,
             cast(1 + e.vec_id % 10 as int) as poignancy, case when e.vec_id % 17 = 0 then 'active' else 'mined' end as source,
             e.embedding
      from embeddings e left join documents d on d.doc_id = e.vec_id) q
"""
_PROGRESS = """
select session, lens, distilled, retries, distilled_at, next_attempt, drift_at from (
  select concat('conv:', c.conv_id) as session, l.lens,
    cast(case when (c.conv_id + l.k) % 4 = 0 then c.n when (c.conv_id + l.k) % 4 = 1 then 1 else 0 end as int) as distilled,
    case when (c.conv_id + l.k) % 4 = 2 then 1 else 0 end as retries,
    case when (c.conv_id + l.k) % 4 < 2 then '2024-03-01T00:00:00Z' else '' end as distilled_at,
    case when (c.conv_id + l.k) % 8 = 2 then '2024-06-01T00:00:00Z'
         when (c.conv_id + l.k) % 8 = 6 then '2024-02-01T00:00:00Z' else '' end as next_attempt,
    case when c.conv_id % 11 = 1 then '2024-03-02T00:00:00Z' else '' end as drift_at
  from (select conv_id, count(*) as n from conversations group by conv_id) c
  cross join (select 'default' as lens, 0 as k union all select 'math', 1) l
  where (c.conv_id + l.k) % 4 <> 3) q
"""
_ASSERT = """
select 'default' as lens, event_type as dimension, concat('u', user_id) as {q}key{q},
       case when value < 20 then 'low' when value < 80 then 'mid' else 'high' end as {q}value{q},
       cast(event_id % 10 as double) / 10 as confidence, concat('ev_', event_id) as obs_id, event_id as ord
from events
"""


def _fill(engine: str) -> dict[str, str]:
    ts = _DUCK_TS if engine == "duck" else _SPARK_TS
    parts = {
        "ts_raw": ts.format(d="conv_id % 90", m="turn"), "ts_obs": ts.format(d="e.vec_id % 90", m="0"),
        "sha1": "sha1", "q": '"' if engine == "duck" else "`",
    }
    return {"raw_v": _RAW.format(**parts), "obs_v": _OBS.format(**parts), "progress_v": _PROGRESS, "assert_v": _ASSERT.format(**parts)}


def with_views(sql: str) -> str:
    """DuckDB SQL over the views; ``sql`` may begin with more ``name as (...),``."""
    views = ",\n".join(f"{name} as ({body})" for name, body in _fill("duck").items() if name in sql)
    body = sql.strip()
    recursive = body.startswith("recursive ")
    body = body.removeprefix("recursive ")
    more = not body.lower().startswith(("select", "from"))
    head = "with " + ("recursive " if recursive else "")
    if views:
        return f"{head}{views}{', ' if more else ' '}{body}"
    return head + body if more else body


def _view(spark: SparkSession, sf_dir: str, name: str, *tables: str) -> DataFrame:
    return spark.sql(_fill("spark")[name].replace("conversations", "{conversations}").replace("from embeddings", "from {embeddings}").replace("join documents", "join {documents}").replace("from events", "from {events}"),
                     **{t: table(spark, sf_dir, t) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "raw_v", "conversations")


def obs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "obs_v", "embeddings", "documents")


def progress_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "progress_v", "conversations")


def assert_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "assert_v", "events")


def staged_v(obs: DataFrame) -> DataFrame:
    """Recorded (active) observations waiting in the stage, as JSON payloads."""
    payload = F.to_json(F.struct("obs_id", "session", "lens", "dimension", "observation", "evidence", "poignancy"))
    return obs.where("source = 'active'").select(F.col("seq").alias("id"), "session", "obs_id", "lens", payload.alias("payload"))


STAGED_SQL = "staged_v as (select seq as id, session, obs_id, lens, dimension, observation, evidence, poignancy from obs_v where source = 'active')"
