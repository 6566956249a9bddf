"""Queries on the log, the work queue and its aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import queue
from ..registry import query
from .bindings import NOW, STAGED_SQL, obs_v, progress_v, raw_v, staged_v

LENSES = ["default", "math"]
_ACTIVE = "active(lens) as (values ('default'), ('math'))"
_TS = "try_cast(case when regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then trim({0}) end as timestamp)"


def _ts(c: str) -> str:
    return _TS.format(c)


_PENDING = f"""
{_ACTIVE}, {STAGED_SQL},
totals as (select session, count(*) as n, max({_ts('ts')}) as updated_at from raw_v group by session),
found as (
  select t.session from totals t cross join active a left join progress_v p on p.session = t.session and p.lens = a.lens
  where t.n > coalesce(p.distilled, 0) and (coalesce(p.next_attempt, '') = '' or p.next_attempt <= '{NOW}')
  union
  select s.session from staged_v s cross join active a left join progress_v p on p.session = s.session and p.lens = a.lens
  where coalesce(p.next_attempt, '') = '' or p.next_attempt <= '{NOW}')
"""


@query("S6_raw_scan", "select id, session, seq, ts, role, effort, text from raw_v")
def raw_scan(spark, d):
    return raw_v(spark, d)


@query("S7_raw_snapshot", "select session, id, max(id) over (partition by session) as raw_high_id from raw_v")
def raw_snapshot(spark, d):
    return raw_v(spark, d).select("session", "id", F.max("id").over(Window.partitionBy("session")).alias("raw_high_id"))


@query("A1_raw_count", "select session, count(*) as n from raw_v group by session")
def raw_count(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.count("*").alias("n"))


@query("A2_last_raw_ts", "select session, coalesce(max(ts), '') as last_ts from raw_v group by session")
def last_raw_ts(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.coalesce(F.max("ts"), F.lit("")).alias("last_ts"))


@query("A3_generation", "select session, coalesce(max(id), 0) as max_id from raw_v group by session")
def generation(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.max("id").alias("max_id"))


@query("A4_session_chars", "select session, cast(sum(length(text)) as bigint) as chars from raw_v group by session")
def session_chars(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.sum(F.length("text")).alias("chars"))


@query("A5_J6_last_distilled_ts", "select r.session, max(r.ts) as last_ts from raw_v r join (select session, max(distilled) as distilled from progress_v group by session) p on p.session = r.session and r.seq < p.distilled group by r.session")
def last_distilled(spark, d):
    return queue.last_distilled_ts(raw_v(spark, d), progress_v(spark, d))


@query("A6_A7_J9_prune_preview", f"select count(distinct session) as sessions, count(*) as n_rows from raw_v where session in (select session from raw_v group by session having max(ts) < '{NOW}' and max(ts) < '2024-02-10')")
def prune_preview(spark, d):
    raw = raw_v(spark, d)
    stale = queue.prune_before(raw, "2024-02-10").select("session")
    return raw.join(stale, "session", "left_semi").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("n_rows"))


@query("A8_unreadable_sessions", f"select count(*) as n from (select session from raw_v group by session having max({_ts('ts')}) is null) q")
def unreadable(spark, d):
    return queue.session_totals(raw_v(spark, d)).where("updated_at is null").agg(F.count("*").alias("n"))


@query(
    "A9_stats",
    _PENDING
    + f"""
select (select count(distinct session) from raw_v) as sessions, (select count(*) from raw_v) as raw_records, (select count(*) from obs_v) as observations,
  (select count(*) from (select distinct lens, dimension, "key" from assert_v) f) as facets, (select count(*) from found) as pending,
  (select count(*) from progress_v where next_attempt > '{NOW}') as backed_off, (select count(*) from progress_v where drift_at <> '') as drifted""",
)
def stats(spark, d):
    from .bindings import assert_v

    obs = obs_v(spark, d)
    facets = assert_v(spark, d).select("lens", "dimension", "key").distinct()
    return queue.stats(raw_v(spark, d), obs, facets, progress_v(spark, d), staged_v(obs), LENSES, NOW)


@query("A10_J4_next_backoff", f"select min(next_attempt) as next_attempt from progress_v where lens in ('default', 'math') and next_attempt > '{NOW}'")
def next_backoff(spark, d):
    return queue.next_backoff(progress_v(spark, d), LENSES, NOW)


@query(
    "A11_J5_O5_pending_chars",
    _ACTIVE
    + """,
least as (select s.session, min(coalesce(p.distilled, 0)) as done from (select distinct session from raw_v) s cross join active a
  left join progress_v p on p.session = s.session and p.lens = a.lens group by s.session),
nth as (select *, row_number() over (partition by session order by id) as nth from raw_v)
select n.session, cast(sum(case when nth > done then length(text) else 0 end) as bigint) as chars from nth n join least l on l.session = n.session group by n.session""",
)
def pending_chars(spark, d):
    return queue.pending_chars(raw_v(spark, d), progress_v(spark, d), LENSES)


@query("A12_sessions_since_review", "select count(distinct session) as n from progress_v where distilled_at > '2024-02-15T00:00:00Z'")
def since_review(spark, d):
    return progress_v(spark, d).where("distilled_at > '2024-02-15T00:00:00Z'").agg(F.countDistinct("session").alias("n"))


@query("A13_poignancy_since", "select lens, cast(sum(poignancy) as bigint) as poignancy from obs_v where seq > 100 group by lens")
def poignancy_since(spark, d):
    return obs_v(spark, d).where("seq > 100").groupBy("lens").agg(F.sum("poignancy").alias("poignancy"))


@query("A14_review_due", "select (select count(distinct session) from progress_v where distilled_at > '2024-02-15T00:00:00Z') >= 5 or (select sum(poignancy) from obs_v where seq > 100) >= 30 as due")
def review_due(spark, d):
    a = progress_v(spark, d).where("distilled_at > '2024-02-15T00:00:00Z'").agg(F.countDistinct("session").alias("n"))
    b = obs_v(spark, d).where("seq > 100").agg(F.sum("poignancy").alias("p"))
    return a.crossJoin(F.broadcast(b)).select(((F.col("n") >= 5) | (F.coalesce("p", F.lit(0)) >= 30)).alias("due"))


@query("A15_unreviewed_delta", "select lens, count(*) as n from obs_v where seq > 100 group by lens")
def unreviewed(spark, d):
    return obs_v(spark, d).where("seq > 100").groupBy("lens").agg(F.count("*").alias("n"))


@query(
    "A16_J7_lens_counts",
    "select lens, count(*) as n, count(*) filter (source = 'active') as n_active, count(*) filter (source <> 'active' and not exists (select 1 from raw_v r where r.session = o.session)) as n_orphans from obs_v o group by lens",
)
def lens_counts(spark, d):
    there = raw_v(spark, d).select("session").distinct().withColumn("there", F.lit(True))
    rows = obs_v(spark, d).select("lens", "session", "source").join(there, "session", "left")
    orphan = (F.col("source") != "active") & F.col("there").isNull()
    return rows.groupBy("lens").agg(F.count("*").alias("n"), F.count(F.when(F.col("source") == "active", 1)).alias("n_active"), F.count(F.when(orphan, 1)).alias("n_orphans"))


@query("J7_orphan_observations", "select obs_id, session from obs_v o where source <> 'active' and not exists (select 1 from raw_v r where r.session = o.session)")
def orphans(spark, d):
    return obs_v(spark, d).where("source <> 'active'").join(raw_v(spark, d), "session", "left_anti").select("obs_id", "session")


@query("A17_staged_counts", STAGED_SQL + " select session, count(*) as n, max(id) as through_id from staged_v group by session")
def staged_counts(spark, d):
    return staged_v(obs_v(spark, d)).groupBy("session").agg(F.count("*").alias("n"), F.max("id").alias("through_id"))


@query("Q1_pending_sessions", _PENDING + "select session from found")
def pending(spark, d):
    return queue.pending_sessions(raw_v(spark, d), staged_v(obs_v(spark, d)), progress_v(spark, d), LENSES, NOW)


@query("J1_raw_branch_default", f"select t.session from (select session, count(*) as n from raw_v group by session) t left join progress_v p on p.session = t.session and p.lens = 'default' where t.n > coalesce(p.distilled, 0) and (coalesce(p.next_attempt, '') = '' or p.next_attempt <= '{NOW}')")
def pending_default(spark, d):
    none = staged_v(obs_v(spark, d)).where(F.lit(False))
    return queue.pending_sessions(raw_v(spark, d), none, progress_v(spark, d), ["default"], NOW)


@query("J2_staged_branch", f"{_ACTIVE}, {STAGED_SQL} select distinct s.session from staged_v s cross join active a left join progress_v p on p.session = s.session and p.lens = a.lens where coalesce(p.next_attempt, '') = '' or p.next_attempt <= '{NOW}'")
def pending_staged(spark, d):
    raw = raw_v(spark, d)
    return queue.pending_sessions(raw.where(F.lit(False)), staged_v(obs_v(spark, d)), progress_v(spark, d), LENSES, NOW)


@query("J3_F6_pending_in_range", _PENDING + "select f.session from found f left join totals t on t.session = f.session where t.updated_at >= timestamp '2024-01-10' and t.updated_at <= timestamp '2024-03-01'")
def pending_in_range(spark, d):
    return queue.pending_sessions(raw_v(spark, d), staged_v(obs_v(spark, d)), progress_v(spark, d), LENSES, NOW, "2024-01-10T00:00:00Z", "2024-03-01T00:00:00Z")


@query("F4_F5_backoff_state", f"select session, lens, (coalesce(next_attempt, '') = '' or next_attempt <= '{NOW}') as ready, coalesce({_ts('next_attempt')} > {_ts(chr(39) + NOW + chr(39))}, false) as backed_off from progress_v")
def backoff_state(spark, d):
    return progress_v(spark, d).select("session", "lens", X.ready(F.col("next_attempt"), F.lit(NOW)).alias("ready"), X.backed_off(F.col("next_attempt"), F.lit(NOW)).alias("backed_off"))


@query("X15_K13_backoff", "select session, lens, retries, least(5 * pow(2.0, greatest(retries, 1) - 1), 360.0) as minutes from (select session, lens, retries + distilled as retries from progress_v) q")
def backoff(spark, d):
    rows = progress_v(spark, d).select("session", "lens", (F.col("retries") + F.col("distilled")).cast("int").alias("retries"))
    return rows.withColumn("minutes", X.backoff_minutes(F.col("retries")))


@query("W1_ordinals", "select id, session, row_number() over (partition by session order by id) - 1 as ordinal from raw_v")
def ordinals(spark, d):
    nth = F.row_number().over(Window.partitionBy("session").orderBy("id")) - 1
    return raw_v(spark, d).select("id", "session", nth.cast("long").alias("ordinal"))


@query("W5_lens_tail", _ACTIVE + ", nth as (select *, row_number() over (partition by session order by id) as nth from raw_v) select n.id, n.session, a.lens from nth n cross join active a left join progress_v p on p.session = n.session and p.lens = a.lens where nth > coalesce(p.distilled, 0)")
def lens_tail(spark, d):
    return queue.lens_tail(raw_v(spark, d), progress_v(spark, d), LENSES).select("id", "session", "lens")


@query("W6_session_ts", "select session, arg_max(ts, id) as ts from raw_v group by session")
def session_ts(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.max_by("ts", "id").alias("ts"))


@query("O2_largest_sessions", "select session, cast(sum(length(text)) as bigint) as chars from raw_v group by session order by chars desc, session limit 10")
def largest(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "session").limit(10)


@query("O3_recent_sessions", "select session, max(ts) as last_ts from raw_v group by session order by last_ts desc, session limit 10")
def recent(spark, d):
    return raw_v(spark, d).groupBy("session").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "session").limit(10)


@query("U1_O7_candidates", _PENDING + "select session from found order by session")
def candidates(spark, d):
    return pending(spark, d).orderBy("session")


@query("K11_J8_cas_marks", "select p.session, p.lens, r.n as distilled from progress_v p join (select session, count(*) as n, max(id) as high from raw_v group by session) r on r.session = p.session where r.high % 2 = 0")
def cas_marks(spark, d):
    raw = raw_v(spark, d)
    totals = raw.groupBy("session").agg(F.count("*").alias("distilled"), F.max("id").alias("high"))
    # Every other session's generation is gone (an id that no row has).
    gen = F.when(F.col("high") % 2 == 0, F.col("high")).otherwise(-F.col("high"))
    marks = progress_v(spark, d).select("session", "lens").join(totals, "session").select("session", "lens", "distilled", gen.alias("raw_high_id"))
    done = queue.commit_watermarks(progress_v(spark, d), raw, marks, NOW)
    return done.where(F.col("distilled_at") == NOW).select("session", "lens", "distilled")


@query("K16_pruned_sessions", "select session, max(ts) as last_ts, count(*) as n from raw_v group by session having max(ts) < '2024-02-10'")
def pruned(spark, d):
    return queue.prune_before(raw_v(spark, d), "2024-02-10")


@query(
    "K5_capped_stage",
    STAGED_SQL + ", n as (select *, row_number() over (partition by session order by id) as a from staged_v) select id, session, obs_id from n where a <= 2",
)
def capped_stage(spark, d):
    from ..operators.tables import stage_capped

    staged = staged_v(obs_v(spark, d))
    return stage_capped(staged.where(F.lit(False)), staged, 2, 0).select("id", "session", "obs_id")


@query("K6_drained_stage", STAGED_SQL + " select id, session, obs_id, dimension, observation, poignancy from staged_v")
def drained(spark, d):
    from ..operators.tables import drain_staged

    return drain_staged(staged_v(obs_v(spark, d))).select("id", "session", "obs_id", "dimension", "observation", "poignancy")
