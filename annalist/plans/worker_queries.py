"""Queries of the worker around the store: runners, passes, settings, migrations."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import models, queue, runners
from ..registry import query
from ..scratch import scratch_root
from ..sources.settings import Lens, Settings, concurrency
from ..store import SCHEMAS, Store
from . import distill
from .bindings import NOW, obs_v, progress_v, raw_v, table
from .store_queries import _engine, _store


def _old_store(spark, **tables) -> Store:
    """A store of the first format: one folder a table, no format in the manifest."""
    s = Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}")
    for name, rows in tables.items():
        rows.write.parquet(f"{s.root}/{name}/old")
    s._publish(f"{s.root}/_manifests/{1:012d}.json", json.dumps({"version": 1, "tables": {n: f"{n}/old" for n in tables}}))
    return s


@query("K22_migrated_columns", "select session, lens, distilled, 0 as retries, distilled_at, '' as next_attempt, '' as drift_at from progress_v")
def migrated_columns(spark, d):
    s = _old_store(spark, progress=progress_v(spark, d).drop("retries", "next_attempt", "drift_at"))
    s.migrate()
    return s.read("progress")


@query("K22_clamped_cursors", "select key, case when key = 'review_rowid:math' then '7' when key = 'other' then '1000000000' else cast((select max(seq) from obs_v) as varchar) end as value from (values ('review_obs_rowid'), ('review_rowid:default'), ('review_rowid:math'), ('other')) q(key)")
def clamped_cursors(spark, d):
    far = "1000000000"
    rows = [("review_obs_rowid", far), ("review_rowid:default", far), ("review_rowid:math", "7"), ("other", far)]
    s = _old_store(spark, observations=obs_v(spark, d), meta=spark.createDataFrame(rows, SCHEMAS["meta"]))
    s.migrate()
    return s.read("meta")


_LENSES_SQL = """select case when n_regionkey % 3 = 0 then 'main' else concat('r', n_regionkey % 3) end as runner,
case when n_nationkey % 4 = 0 then '' else concat('m', n_nationkey % 4) end as mine, case when n_nationkey % 5 = 0 then 'big' else '' end as review from nation"""


def _lenses(spark, d) -> tuple[Settings, list[Lens]]:
    """A lens for each nation, some with runners and models of their own."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()
    own = lambda r: Lens(f"n{r[0]}", runner=f"r{r[1] % 3}" if r[1] % 3 else "", model=f"m{r[0] % 4}" if r[0] % 4 else "", review_model="big" if r[0] % 5 == 0 else "")
    return Settings(runner="main", mine_model="small"), [own(r) for r in rows]


@query(
    "A26_U6_model_sets",
    f"""with l as ({_LENSES_SQL}), m as (select runner, mine as model from l union select runner, review from l union select 'main', 'small')
select runner, string_agg(model, ',' order by model) as models from m where model <> '' group by runner""",
    views=False,
)
def model_sets(spark, d):
    settings, lenses = _lenses(spark, d)
    told = runners.model_sets(settings, lenses)
    return spark.createDataFrame([(name, ",".join(told[name])) for name in runners.runner_names(settings, lenses)], "runner string, models string")


@query(
    "T5_model_precedence",
    """select concat('n', n_nationkey) as lens, case when n_nationkey % 4 <> 0 then concat('m', n_nationkey % 4) when n_regionkey % 3 = 0 then 'small' else '' end as mine,
case when n_nationkey % 5 = 0 then 'big' when n_regionkey % 3 = 0 then 'small' else '' end as review from nation""",
    views=False,
)
def model_precedence(spark, d):
    settings, lenses = _lenses(spark, d)
    return spark.createDataFrame([(x.name, *(runners.model_for(settings, x, p) for p in ("mine", "review"))) for x in lenses], "lens string, mine string, review string")


def _refuses() -> None:
    raise ConnectionError("no answer")


@query(
    "T5_Q4_broken_runner",
    "g as (select session, count(*) as n from raw_v group by session) select session, 'default' as lens, n as distilled, 0 as retries, '' as next_attempt from g union all select session, 'math', 0, 1, '2024-04-01T00:05:00Z' from g",
)
def broken_runner(spark, d):
    """A lens whose runner can't be opened backs off; the other one is read whole."""
    s = _store(spark, raw=raw_v(spark, d))
    there = {"main": runners.LocalRunner({"": models.echo_miner}), "gone": runners.LocalRunner({"": models.echo_miner}, on_open=_refuses)}
    with runners.RunnerSet(there, Settings(runner="main"), [Lens("default"), Lens("math", runner="gone")]) as opened:
        distill.drain(s, ["default", "math"], opened.model, NOW)
    return s.read("progress").select("session", "lens", F.col("distilled").cast("long").alias("distilled"), "retries", "next_attempt")


@query("Q4_attempted_once", "select session, 'math' as lens, count(*) as n from raw_v group by session having max(id) % 3 <> 0")
def attempted_once(spark, d):
    """Sessions that were tried at their present length aren't tried again; one
    that has grown since, or that another lens tried, is."""
    totals = queue.session_totals(raw_v(spark, d))
    third = F.col("max_id") % 3
    lens = F.when(third == 2, "default").otherwise("math").alias("lens")
    tried = totals.select("session", lens, (F.col("n") - F.when(third == 1, 1).otherwise(0)).alias("n"))
    return distill.unattempted(totals.select("session"), totals, "math", tried)


@query(
    "Z9_windows",
    "select distinct w, late, case when w > 1 and late >= (w + 1) // 2 then w // 2 else w end as next_window from (select vec_id % 16 + 1 as w, vec_id % 17 as late from embeddings) q",
    views=False,
)
def windows(spark, d):
    @F.udf("long")
    def after(w: int, late: int) -> int:
        pace = distill.Pace(w)
        pace.starved(late, 8)
        return pace.window

    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 16 + 1).alias("w"), (F.col("vec_id") % 17).alias("late")).distinct()
    return rows.withColumn("next_window", after("w", "late"))


@query("Z9_task_budget", "select session, greatest(8, cast(ceil(sum(length(text)) / 1000.0) as bigint)) as tasks from raw_v group by session having sum(length(text)) is not null")
def task_budget(spark, d):
    tasks = F.udf(lambda chars: distill.Pace(0, 1000).tasks(chars, 8), "long")
    return queue.session_totals(raw_v(spark, d)).where("chars is not null").select("session", tasks("chars").alias("tasks"))


@query("X22_concurrency", "select distinct asked, cores, greatest(1, least(asked, 16, cores)) as safe, 1 as unsafe from (select vec_id % 23 - 2 as asked, vec_id % 7 + 1 as cores from embeddings) q", views=False)
def clamped_concurrency(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 23 - 2).alias("asked"), (F.col("vec_id") % 7 + 1).alias("cores")).distinct()
    return rows.select("asked", "cores", F.udf(concurrency, "long")("asked", "cores").alias("safe"), F.udf(lambda a, c: concurrency(a, c, False), "int")("asked", "cores").alias("unsafe"))


@query(
    "Q8_seeded",
    "select q.name, case when q.name = 'old' and not exists (select 1 from progress_v where lens = 'default') then 'not needed' else decided end as decided from (values ('new', 'done'), ('old', 'done'), ('other', 'not needed'), ('declined', 'declined')) q(name, decided)",
)
def seeded(spark, d):
    progress, raw = progress_v(spark, d), raw_v(spark, d)
    made = {"new": {}, "old": {"progress": progress, "raw": raw}, "other": {"progress": progress.where("lens = 'math'"), "raw": raw}, "declined": {}}
    rows = []
    for name, tables in made.items():
        e = _engine(spark, **tables)
        e.seed(declined=name == "declined")
        e.disable("default")
        rows.append((name, e.seed()))  # what was decided stays
    return spark.createDataFrame(rows, "name string, decided string")


@query("R14_settings", "select * from (values ('runner', 'claude'), ('mine_model', 'from outside'), ('review_model', 'big'), ('review_every', '9')) q(key, value)", views=False)
def settings_scopes(spark, d):
    e = Engine(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}", clock=lambda: NOW, environment={"mine_model": "from outside", "runner": "x"})
    for key, value in (("runner", "claude"), ("triage_model", "small"), ("distill_model", "big"), ("review_every", "9")):
        e.config_set(key, value)
    e.config_unset("extract_model")
    return spark.createDataFrame([(k, e.config_get(k)) for k in ("runner", "mine_model", "review_model", "review_every")], "key string, value string")


@query("Z5_next_wakeup", f"select cast(epoch(min(cast(next_attempt as timestamp))) - epoch(timestamp '2024-04-01') as bigint) as seconds from progress_v where lens = 'default' and next_attempt > '{NOW}'")
def next_wakeup(spark, d):
    wait = _engine(spark, progress=progress_v(spark, d)).next_wakeup()
    return spark.createDataFrame([(None if wait is None else int(wait),)], "seconds long")


@query("B4_review_preview", "select dimension, 'k' as key, count(*) as n, cast(0 as bigint) as stored from obs_v where lens = 'math' and seq <= 60 group by dimension")
def review_preview(spark, d):
    def model(page: str) -> str:
        ids: dict[str, list[str]] = {}
        for r in json.loads(page[page.rindex("\n[") + 1 :]):
            ids.setdefault(r["dimension"], []).append(r["obs_id"])
        return json.dumps([{"dimension": k, "key": "k", "value": "v", "confidence": 0.5, "because_of": v} for k, v in ids.items()])

    obs = obs_v(spark, d).where("seq <= 60").withColumn("observation", F.lit("o")).withColumn("evidence", F.lit(""))
    e = Engine(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex}", {"": model}, clock=lambda: NOW)
    e.store.commit({"observations": obs})
    rows = e.preview_review("math").select("dimension", "key", F.size("because_of").cast("long").alias("n"))
    return rows.withColumn("stored", F.lit(e.store.read("facet_versions").count()).cast("long"))


@query("Q7_backfilled_lens", "select session, 'math' as lens, count(*) as distilled, true as complete from raw_v group by session")
def backfilled(spark, d):
    e = _engine(spark, raw=raw_v(spark, d), progress=progress_v(spark, d))
    e.set_setting("review_max_chars", "1000000000")  # one window
    told = e.backfill("math", fresh=True)
    return e.store.read("progress").where("lens = 'math'").select("session", "lens", F.col("distilled").cast("long").alias("distilled"), F.lit(told["complete"]).alias("complete"))
