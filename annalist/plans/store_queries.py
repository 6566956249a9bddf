"""Queries that change a store made of the supplied tables and read it again.

Each takes a store of its own in the shared scratch folder, applies the
operation to whole tables, and returns a table as it is afterwards."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import scalars as X
from ..operators import history, ingest, vectors
from ..registry import query
from ..scratch import scratch_root
from ..sources.settings import time_bound
from ..store import SCHEMAS, Conflict, Store
from . import distill
from .bindings import NOW, STAGED_SQL, assert_v, obs_v, progress_v, raw_v, staged_v, table

_HIGH = "g as (select session, count(*) as n, max(id) as high from raw_v group by session)"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"


def _store(spark: SparkSession, **tables: DataFrame) -> Store:
    s = Store(spark, _folder(spark))
    if tables:
        s.commit(tables)
    return s


def _engine(spark: SparkSession, **tables: DataFrame) -> Engine:
    e = Engine(spark, _folder(spark), clock=lambda: NOW)
    if tables:
        e.store.commit(tables)
    return e


def _versions(asserts: DataFrame) -> DataFrame:
    rows = asserts.groupBy("lens", "dimension", "key").agg(F.max("value").alias("value"), F.max("confidence").alias("confidence"))
    empty = F.array().cast("array<string>")
    return rows.select("lens", "dimension", "key", F.lit(NOW).alias("last_seen"), F.lit(0).alias("pos"), "value", F.lit(NOW).alias("valid_from"), F.lit("").alias("valid_to"), F.lit(NOW).alias("recorded_at"), empty.alias("because_of"), "confidence")


@query("K1_append_raw", "select session, seq, role, seq >= 2 as later from raw_v")
def append_raw(spark, d):
    raw = raw_v(spark, d)
    s = _store(spark, raw=raw.where("seq < 2"))
    high = s.next_id() - 1
    s.append_raw(raw.where("seq >= 2").select("session", "ts", "role", "effort", "text", "seq"))
    return s.read("raw").select("session", "seq", "role", (F.col("id") > high).alias("later"))


@query("K7_clear_staged", STAGED_SQL + " select id, session from staged_v where session <> 'conv:0' or id > 200")
def clear_staged(spark, d):
    s = _store(spark, staged=staged_v(obs_v(spark, d)))
    s.clear_staged("conv:0", 200)
    return s.read("staged").select("id", "session")


@query("K8_delete_observation", "select seq, 'review_rowid:default' as cursors from obs_v where seq <> 1")
def delete_observation(spark, d):
    s = _store(spark, observations=obs_v(spark, d), meta=spark.createDataFrame([("review_rowid:math", "5"), ("review_rowid:default", "7")], SCHEMAS["meta"]))
    s.delete_observation(s.read("observations").where("seq = 1").first()["obs_id"])
    left = s.read("meta").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("cursors"))
    return s.read("observations").select("seq").crossJoin(F.broadcast(left))


@query("K9_replaced_facets", "select distinct lens, dimension, key from assert_v where key like 'u1%'")
def replaced_facets(spark, d):
    rows = assert_v(spark, d)
    s = _store(spark, facet_versions=_versions(rows))
    s.commit({"facet_versions": _versions(rows.where("key like 'u1%'"))})
    return s.read("facet_versions").select("lens", "dimension", "key")


def _distilled(spark: SparkSession, d: str) -> Store:
    """A commit of marks of which every other generation is gone, over stored progress."""
    raw, obs = raw_v(spark, d), obs_v(spark, d)
    s = _store(spark, raw=raw, progress=progress_v(spark, d), observations=obs.where("seq <= 10"))
    totals = raw.groupBy("session").agg(F.count("*").cast("int").alias("distilled"), F.max("id").alias("high"))
    gen = F.when(F.col("high") % 2 == 0, F.col("high")).otherwise(-F.col("high"))
    marks = totals.select("session", F.lit("math").alias("lens"), "distilled", gen.alias("raw_high_id"), (F.col("distilled") >= 5).alias("drifted"))
    s.commit_distillation(obs.where("lens = 'math'").drop("seq"), marks, NOW)
    return s


@query("K12_Q3_committed_observations", _HIGH + " select obs_id, session, lens from obs_v where seq <= 10 or (lens = 'math' and session in (select session from g where high % 2 = 0))")
def committed_observations(spark, d):
    return _distilled(spark, d).read("observations").select("obs_id", "session", "lens")


@query(
    "K12_K13_committed_progress",
    _HIGH + """ select session, 'math' as lens, n as distilled, 0 as retries, '' as next_attempt from g where high % 2 = 0
union all select session, lens, distilled, retries, next_attempt from progress_v where not (lens = 'math' and session in (select session from g where high % 2 = 0))""",
)
def committed_progress(spark, d):
    return _distilled(spark, d).read("progress").select("session", "lens", F.col("distilled").cast("long").alias("distilled"), "retries", "next_attempt")


@query("A25_drift_counter", _HIGH + " select cast(count(*) as varchar) as total, count(*) as stamped, max(session) as last_session from g where high % 2 = 0 and n >= 5")
def drift_counter(spark, d):
    s = _distilled(spark, d)
    return s.read("progress").where(F.col("drift_at") == NOW).agg(F.lit(s.get("mine_drift_total", "0")).alias("total"), F.count("*").alias("stamped"), F.max("session").alias("last_session"))


@query("K14_reset_lens", "select session, lens, 'review_rowid:default' as cursors from progress_v where lens <> 'math'")
def reset_lens(spark, d):
    s = _store(spark, progress=progress_v(spark, d), meta=spark.createDataFrame([("review_rowid:math", "5"), ("review_rowid:default", "7")], SCHEMAS["meta"]))
    s.reset_lens("math")
    left = s.read("meta").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("cursors"))
    return s.read("progress").select("session", "lens").crossJoin(F.broadcast(left))


@query("K17_R11_export", "select 'raw' as name, count(*) as n from raw_v union all select 'observations', count(*) from obs_v union all select 'progress', count(*) from progress_v")
def exported(spark, d):
    s, target = _store(spark, raw=raw_v(spark, d), observations=obs_v(spark, d), progress=progress_v(spark, d)), _folder(spark)
    s.export(target)
    parts = [spark.read.parquet(f"{target}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("raw", "observations", "progress")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("K18_counter", "select 'n' as key, cast(2 * count(*) as varchar) as value from raw_v")
def counter(spark, d):
    s, n = _store(spark), raw_v(spark, d).count()
    s.increment("n", n)
    s.increment("n", n)
    return s.read("meta").select("key", "value")


@query("K19_session_meta", "select session, concat('first of ', session) as cwd, case when session = 'conv:0' then 'file' else 'claude' end as platform from raw_v group by session")
def session_meta(spark, d):
    sessions = raw_v(spark, d).select("session").distinct()
    told = lambda word: sessions.select("session", F.concat(F.lit(f"{word} of "), "session").alias("cwd"), F.lit(NOW).alias("started"), F.lit("claude").alias("platform"))
    s = _store(spark)
    s.record_meta(told("first"))
    s.record_meta(told("second"))
    s.set_platform("conv:0", "file")
    return s.read("session_meta").select("session", "cwd", "platform")


@query("K20_R3_profiles", "select 'math' as lens, concat('page ', count(*)) as markdown from obs_v")
def profiles(spark, d):
    s = _store(spark)
    for lens in ("default", "math"):
        s.write_profile(lens, f"page {obs_v(spark, d).count()}", "s")
    s.delete_profile("default")
    return s.read("profiles").select("lens", "markdown")


@query("K21_one_writer_wins", "select 1 as refused, 2 as version, count(*) as n from raw_v", views=True)
def one_writer(spark, d):
    s, rows = _store(spark, raw=raw_v(spark, d)), raw_v(spark, d)
    version, refused = s.manifest()["version"], 0
    for _ in range(2):
        try:
            s.commit({"raw": rows}, version)
        except Conflict:
            refused += 1
    return s.read("raw").agg(F.lit(refused).alias("refused"), F.lit(s.manifest()["version"]).alias("version"), F.count("*").alias("n"))


@query(
    "B2_cited_evidence",
    "select dimension, string_agg(obs_id, ',' order by seq) as because_of, count(*) as n from obs_v where lens = 'math' and seq <= 60 group by dimension",
)
def cited_evidence(spark, d):
    def model(page: str) -> str:
        batch = json.loads(page[page.rindex("\n[") + 1 :])
        ids: dict[str, list[str]] = {}
        for r in batch:
            ids.setdefault(r["dimension"], []).append(r["obs_id"])
        return json.dumps([{"dimension": k, "key": "k", "value": "v", "confidence": 0.5, "because_of": v} for k, v in ids.items()])

    s = _store(spark, observations=obs_v(spark, d).where("seq <= 60").withColumn("observation", F.lit("o")).withColumn("evidence", F.lit("")))
    distill.review(s, "math", model, NOW)
    return s.read("facet_versions").select("dimension", F.array_join("because_of", ",").alias("because_of"), F.size("because_of").cast("long").alias("n"))


@query("K23_R13_review_stamp", "select max(seq) as seq, '2024-04-01T00:00:00Z' as ts from obs_v")
def review_stamp(spark, d):
    e = _engine(spark, observations=obs_v(spark, d))
    e.store.set({f"review_rowid:{lens}": "1000000000" for lens in e.lenses()})  # nothing is left to fold
    e.review()
    return spark.createDataFrame([(int(e.store.get("review_obs_rowid")), e.store.get("review_ts"))], "seq long, ts string")


@query("Z1_captured_seq", "select session, count(*) as n, cast(sum(seq) as bigint) as total, max(seq) as last from raw_v group by session")
def captured_seq(spark, d):
    raw = raw_v(spark, d)
    events = raw.where("seq >= 2").select(F.col("session").alias("session_id"), F.col("text").alias("prompt"), F.lit("-").alias("last_assistant_message"), F.col("effort"))
    rows = ingest.in_sequence(ingest.capture(events, NOW), raw.where("seq < 2"))
    both = raw.where("seq < 2").select("session", "seq").unionByName(rows.select("session", "seq"))
    return both.groupBy("session").agg(F.count("*").alias("n"), F.sum("seq").alias("total"), F.max("seq").alias("last"))


@query("Z4_insert_once", "select obs_id, session from obs_v")
def insert_once(spark, d):
    s, rows = _store(spark), obs_v(spark, d).drop("seq")
    s.add_observations(rows)
    s.add_observations(rows)
    return s.read("observations").select("obs_id", "session")


@query("Z6_late_rows", "select session, 'default' as lens, count(*) - least(2, count(*)) as pending from raw_v group by session having count(*) > 2")
def late_rows(spark, d):
    """Watermarks set before later turns arrive leave just those pending."""
    from ..operators import queue

    raw = raw_v(spark, d)
    s = _store(spark, raw=raw.where("seq < 2"))
    totals = queue.session_totals(s.read("raw")).select("session", F.lit("default").alias("lens"), F.col("n").cast("int").alias("distilled"), F.col("max_id").alias("raw_high_id"))
    s.commit_distillation(spark.createDataFrame([], SCHEMAS["observations"]).drop("seq"), totals, NOW)
    s.append_raw(raw.where("seq >= 2").select("session", "ts", "role", "effort", "text", "seq"))
    tail = queue.lens_tail(s.read("raw"), s.read("progress"), ["default"])
    return tail.groupBy("session", "lens").agg(F.count("*").alias("pending"))


@query("Z7_replaced_session", "select session, count(*) as n, count(*) filter (where session <> 'conv:1') as old from raw_v group by session")
def replaced_session(spark, d):
    raw = raw_v(spark, d)
    s = _store(spark, raw=raw, progress=progress_v(spark, d))
    new = raw.where("session = 'conv:1'").select("session", "seq", "ts", "role", "effort", F.lit("anew").alias("text"))
    meta = spark.createDataFrame([("conv:1", "", NOW, "file")], SCHEMAS["session_meta"])
    s.import_sessions(new, meta, spark.createDataFrame([("file_import_keys:conv:1", "[]")], SCHEMAS["meta"]), True)
    return s.read("raw").groupBy("session").agg(F.count("*").alias("n"), F.count(F.when(F.col("text") != "anew", 1)).alias("old"))


@query("R2_facets", "select distinct dimension, key from assert_v")
def facets(spark, d):
    return _engine(spark, facet_versions=_versions(assert_v(spark, d))).facets("default").select("dimension", "key")


@query("R4_R5_record_and_delete", "select seq from obs_v where seq > 3")
def record_and_delete(spark, d):
    e = _engine(spark, observations=obs_v(spark, d))
    for r in e.store.read("observations").where("seq <= 3").collect():
        e.delete(r["obs_id"])
    return e.store.read("observations").select("seq")


@query("R6_ingest", "select concat('file:', source) as session, count(distinct text) as n from documents where trim(text) <> '' group by source", views=False)
def ingested(spark, d):
    e, where = _engine(spark), _folder(spark)
    docs = table(spark, d, "documents").where("trim(text) <> ''")
    docs.select(F.to_json(F.struct(F.col("source").alias("session"), "text")).alias("value")).write.text(where)
    e.ingest(where)
    e.ingest(where)  # changes nothing
    return e.store.read("raw").groupBy("session").agg(F.count("*").alias("n"))


@query(
    "R8_status",
    "select (select count(distinct session) from raw_v) as sessions, (select count(*) from raw_v) as raw_records, (select count(*) from obs_v) as observations, (select count(*) from (select distinct lens, dimension, key from assert_v) q) as facets",
)
def status(spark, d):
    e = _engine(spark, raw=raw_v(spark, d), observations=obs_v(spark, d), progress=progress_v(spark, d), facet_versions=_versions(assert_v(spark, d)))
    row = e.status()
    return spark.createDataFrame([tuple(row[k] for k in ("sessions", "raw_records", "observations", "facets"))], "sessions long, raw_records long, observations long, facets long")


@query("R10_cleanup", "select session, count(*) as n from raw_v group by session having max(ts) >= '2024-03-02T00:00:00Z'")
def cleaned(spark, d):
    e = _engine(spark, raw=raw_v(spark, d), progress=progress_v(spark, d))
    e.cleanup(30, confirm=True)
    return e.store.read("raw").groupBy("session").agg(F.count("*").alias("n"))


@query("O8_facet_order", "select lens, dimension, key, row_number() over (order by lens, dimension, key) as nth from (select distinct lens, dimension, key from assert_v) q")
def facet_order(spark, d):
    rows = history.nested_facets(_versions(assert_v(spark, d))).select("lens", "dimension", "key").orderBy("lens", "dimension", "key")
    return rows.select("lens", "dimension", "key", F.expr("row_number() over (order by lens, dimension, key)").cast("long").alias("nth"))


@query(
    "F7_time_bounds",
    "select page_id, strftime(timestamp '2024-04-01' - case page_id % 3 when 0 then to_hours(page_id) + to_minutes(30) when 1 then to_days(page_id) else to_days(7 * page_id) end, '%Y-%m-%d %H:%M:%S') as bound from (select cast(page_id % 400 as int) as page_id from pages) q group by page_id",
    views=False,
)
def time_bounds(spark, d):
    @F.udf("string")
    def bound(n: int) -> str:
        text = (f"{n}h30m", f"{n}d", f"{n}w")[n % 3]
        return time_bound(text, datetime(2024, 4, 1, tzinfo=UTC)).strftime("%Y-%m-%d %H:%M:%S")

    pages = table(spark, d, "pages").select((F.col("page_id") % 400).cast("int").alias("page_id")).distinct()
    return pages.select("page_id", bound("page_id").alias("bound"))


@query(
    "X20_k_bands",
    "select n, case when n < 3 then '1' else array_to_string(range(least(2, least(cast(ceil(log2(n)) as bigint), n - 1)), least(cast(ceil(log2(n)) as bigint), n - 1) + 1), ',') end as band from (select vec_id + 1 as n from embeddings) q",
    views=False,
)
def k_bands(spark, d):
    band = F.udf(lambda n: ",".join(map(str, X.k_band(n))), "string")
    return table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("n")).withColumn("band", band("n"))


@query("S18_vector_codec", "select vec_id, 4 * len(embedding) as octets, true as same from embeddings where embedding is not null and len(embedding) > 0", views=False)
def vector_codec(spark, d):
    encode = F.udf(vectors.encode_floats, "binary")
    rows = table(spark, d, "embeddings").where("size(embedding) > 0")
    told = rows.select("vec_id", F.col("embedding").cast("array<float>").alias("want"), encode("embedding").alias("embedding"))
    told = told.withColumn("octets", F.octet_length("embedding").cast("long"))
    back = told.mapInPandas(vectors.decode_floats(), "vec_id long, want array<float>, embedding array<float>, octets long")
    return back.select("vec_id", "octets", (F.col("want") == F.col("embedding")).alias("same"))


@query("F11_query_guard", "select page_id, length(trim(url)) > 0 and octet_length(encode(trim(url))) <= 8000 as ok from pages", views=False)
def query_guard(spark, d):
    from ..functions.scalars import LIMITS

    url = F.trim("url")
    return table(spark, d, "pages").select("page_id", ((url != "") & ~X.too_long(url, LIMITS["query"])).alias("ok"))


@query("X11_prefix_escape", "select key from (select 'emerge_seen:ma_h:1' as key union all select 'other' union all select concat('emerge_seen:math:', vec_id) from embeddings) q where key <> 'emerge_seen:ma_h:1'", views=False)
def prefix_escape(spark, d):
    from ..operators.tables import delete_lens_meta

    keys = table(spark, d, "embeddings").select(F.concat(F.lit("emerge_seen:math:"), F.col("vec_id").cast("string")).alias("key"))
    keys = keys.unionByName(spark.createDataFrame([("emerge_seen:ma_h:1",), ("other",)], "key string"))
    return delete_lens_meta(keys, "ma_h").select("key")
