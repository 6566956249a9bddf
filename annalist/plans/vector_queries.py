"""Queries on vectors, graphs, arcs and facet history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import arcs, history, text, vectors
from ..operators.graph import components
from ..registry import query
from .bindings import assert_v, obs_v

_VEC = "vec as (select seq, lens, session, ts, obs_id, poignancy, cast(embedding as double[]) as v from obs_v where len(embedding) > 0)"
_COS = "list_cosine_similarity(a.v, b.v)"
_KNN = f"{_VEC}, near as (select a.seq as i, b.seq as j, {_COS} as score, row_number() over (partition by a.seq order by {_COS} desc, b.seq) as rank from vec a join vec b on a.seq <> b.seq)"
_MUTUAL = _KNN + ", edges as (select x.i, x.j from near x join near y on x.i = y.j and x.j = y.i where x.rank <= {k} and y.rank <= {k} and x.i < x.j)"
_REACH = ", b as (select i as u, j as v from edges union select j, i from edges), reach as (select u as node, u as other from b union select r.node, b.v from reach r join b on b.u = r.other)"
#: Islands of equal values within a facet, in order.
_VERSIONS = """
l as (select *, lag("value") over (partition by lens, dimension, "key" order by ord) as before from assert_v),
s as (select *, sum(case when before is null or before <> "value" then 1 else 0 end) over (partition by lens, dimension, "key" order by ord) - 1 as pos from l),
versions as (select lens, dimension, "key", cast(pos as int) as pos, min("value") as "value", max(confidence) as confidence, min(ord) as since, max(ord) as last_seen,
  string_agg(obs_id, ',' order by ord) as because_of from s group by lens, dimension, "key", pos),
facets as (select *, lead(since) over (partition by lens, dimension, "key" order by pos) as until from versions)
"""
K = 5
_PROBE_SQL = "(select cast(embedding as double[]) from obs_v where seq = 1)"


def _probe(obs):
    return obs.where("seq = 1").select(F.col("embedding").alias("_q"))


@query("S8_observations", "select seq, obs_id, ts, session, lens, dimension, poignancy, source from obs_v where lens = 'math'")
def observations(spark, d):
    return obs_v(spark, d).where("lens = 'math'").select("seq", "obs_id", "ts", "session", "lens", "dimension", "poignancy", "source")


@query("S9_F13_delta_scan", "select seq, obs_id, dimension, observation, poignancy from obs_v where lens = 'default' and seq > 100")
def delta(spark, d):
    return obs_v(spark, d).where("lens = 'default' and seq > 100").select("seq", "obs_id", "dimension", "observation", "poignancy")


@query("O1_recall", f"{_VEC} select seq, obs_id, list_cosine_similarity(v, {_PROBE_SQL}) as score from vec where lens = 'default' order by score desc, seq limit 8")
def recall(spark, d):
    obs = obs_v(spark, d)
    rows = obs.crossJoin(F.broadcast(_probe(obs)))
    return vectors.search(rows, F.col("_q"), "default", X.DEFAULT_K).select("seq", "obs_id", "score")


@query("F1_F2_lens_and_vector_filter", f"{_VEC} select seq, lens from vec where lens = 'math'")
def lens_filter(spark, d):
    return vectors.embedded(obs_v(spark, d), "math").select("seq", "lens")


@query("X17_X18_similarities", f"select seq, list_cosine_similarity(cast(embedding as double[]), {_PROBE_SQL}) as cosine, list_dot_product(cast(embedding as double[]), {_PROBE_SQL}) as dot from obs_v")
def similarities(spark, d):
    obs = obs_v(spark, d)
    rows = obs.crossJoin(F.broadcast(_probe(obs)))
    return rows.select("seq", X.cosine(F.col("embedding"), F.col("_q")).alias("cosine"), X.dot(F.col("embedding"), F.col("_q")).alias("dot"))


@query("J12_W2_nearest", _KNN + f" select i, j, score, cast(rank as int) as rank from near where rank <= {K}")
def nearest(spark, d):
    return vectors.nearest(vectors.embedded(obs_v(spark, d)), K)


@query("G1_J13_mutual_knn", _MUTUAL.format(k=K) + " select i, j from edges")
def mutual(spark, d):
    return vectors.mutual_edges(vectors.nearest(vectors.embedded(obs_v(spark, d)), K), K)


@query("G2_components", "recursive " + _MUTUAL.format(k=2) + _REACH + " select node, min(other) as component from reach group by node")
def connected(spark, d):
    edges = vectors.mutual_edges(vectors.nearest(vectors.embedded(obs_v(spark, d)), 2), 2)
    return components(edges.select(F.col("i").alias("u"), F.col("j").alias("v")))


@query("G3_A24_persistent_groups")
def persistent(spark, d):
    rows = vectors.embedded(obs_v(spark, d), "math")
    return vectors.persistent_groups(rows)


@query(
    "A21_centroids",
    _VEC + ", x as (select lens, generate_subscripts(v, 1) as p, unnest(v) as x from vec), m as (select lens, p, avg(x) as m from x group by lens, p), n as (select lens, sqrt(sum(m * m)) as n from m group by lens) "
    "select m.lens, cast(p - 1 as int) as \"at\", round(m.m / n.n, 9) as x from m join n on n.lens = m.lens",
)
def centroids(spark, d):
    out = vectors.centroids(vectors.embedded(obs_v(spark, d)), "lens")
    return out.select("lens", F.posexplode("centroid").alias("at", "x")).select("lens", "at", F.round("x", 9).alias("x"))


@query(
    "A22_J15_reexpansion",
    _VEC + ", g as (select *, cast(seq % 5 as bigint) as arc from vec), x as (select arc, generate_subscripts(v, 1) as p, unnest(v) as x from g), m as (select arc, p, avg(x) as m from x group by arc, p), "
    "n as (select arc, sqrt(sum(m * m)) as n from m group by arc), c as (select m.arc, list(m.m / n.n order by p) as c from m join n on n.arc = m.arc group by m.arc), "
    "r as (select g.arc, min(list_dot_product(g.v, c.c)) as radius from g join c on c.arc = g.arc group by g.arc) "
    "select c.arc, count(*) as n from c join r on r.arc = c.arc join vec on list_dot_product(vec.v, c.c) >= r.radius - 1e-12 group by c.arc",
)
def reexpansion(spark, d):
    obs = vectors.embedded(obs_v(spark, d))
    members = obs.withColumn("arc", F.col("seq") % 5)
    return vectors.reexpand(members, obs, "arc").groupBy("arc").agg(F.count("*").alias("n"))


@query(
    "A18_A19_A20_G5_arc_descriptions",
    "m as (select *, dimension as arc from obs_v) select arc, count(*) as n, count(distinct session) as sessions, count(distinct case when ts <> '' then substr(ts, 1, 10) end) as days, "
    "min(ts) filter (ts <> '') as span_from, max(ts) filter (ts <> '') as span_to, cast(sum(poignancy) as bigint) as poignancy from m group by arc having count(distinct session) >= 2",
)
def descriptions(spark, d):
    told = arcs.describe_arcs(obs_v(spark, d).withColumn("arc", F.col("dimension"))).where(F.size("sessions") >= 2)
    return told.select("arc", "n", F.size("sessions").cast("long").alias("sessions"), "days", "span_from", "span_to", "poignancy")


_CITED = "cited as (select distinct lens, dimension as fd, cast(seq % 7 as varchar) as fk, obs_id from obs_v where seq % 3 = 0)"


@query(
    "A23_J14_coverage",
    _CITED + """, h as (select o.dimension as arc, c.lens, c.fd, c.fk, count(*) as hits from (select distinct dimension, obs_id from obs_v) o join cited c on c.obs_id = o.obs_id group by all),
t as (select *, row_number() over (partition by arc order by hits desc, lens, fd, fk) as nth from h),
z as (select dimension as arc, count(distinct obs_id) as size from obs_v group by dimension)
select z.arc, coalesce(t.hits / z.size, 0.0) as coverage, coalesce(t.fd || '|' || t.fk, '') as facet from z left join t on t.arc = z.arc and t.nth = 1""",
)
def covered(spark, d):
    obs = obs_v(spark, d)
    cited = obs.where("seq % 3 = 0").select("lens", "dimension", (F.col("seq") % 7).cast("string").alias("key"), "obs_id")
    return arcs.coverage(obs.withColumn("arc", F.col("dimension")), cited)


@query("G4_G6_U3_O4_candidate_arcs")
def candidate_arcs(spark, d):
    obs = obs_v(spark, d)
    cited = obs.where("seq % 3 = 0").select("lens", "dimension", (F.col("seq") % 7).cast("string").alias("key"), "obs_id")
    return arcs.candidates(obs, cited, "math").orderBy(*arcs.salience())


@query("X3_arc_signatures", "select dimension as arc, substr(sha256(concat('default', chr(0), string_agg(obs_id, ',' order by obs_id))), 1, 24) as signature from obs_v group by dimension")
def signatures(spark, d):
    return obs_v(spark, d).groupBy(F.col("dimension").alias("arc")).agg(X.arc_signature(F.lit("default"), F.collect_list("obs_id")).alias("signature"))


@query("B1_bitemporal_fold", _VERSIONS + ' select lens, dimension, "key", pos, "value", confidence, since, until, because_of, last_seen from facets')
def bitemporal(spark, d):
    return history.version_islands(assert_v(spark, d)).withColumn("because_of", F.array_join("because_of", ","))


@query("W7_version_chain", _VERSIONS + ' select lens, dimension, "key", pos, since, until from facets')
def version_chain(spark, d):
    return history.version_islands(assert_v(spark, d)).select("lens", "dimension", "key", "pos", "since", "until")


@query("S10_J10_nested_facets", _VERSIONS + ' select lens, dimension, "key", count(*) as n, string_agg("value", \'>\' order by pos) as path from facets group by lens, dimension, "key"')
def nested(spark, d):
    out = history.nested_facets(history.version_islands(assert_v(spark, d)))
    return out.select("lens", "dimension", "key", F.size("versions").cast("long").alias("n"), F.array_join(F.transform("versions", lambda v: v["value"]), ">").alias("path"))


@query("F3_current_versions", _VERSIONS + ' select lens, dimension, "key", "value", confidence from facets where until is null')
def current(spark, d):
    versions = history.version_islands(assert_v(spark, d)).withColumn("valid_to", F.coalesce(F.col("until").cast("string"), F.lit("")))
    out = history.nested_facets(versions.select("lens", "dimension", "key", "pos", "value", "confidence", "valid_to"))
    now = X.current_version(F.col("versions"))
    return out.select("lens", "dimension", "key", now["value"].alias("value"), now["confidence"].alias("confidence"))


@query("J17_facet_assertion_join", _VERSIONS + ' select f.lens, f.dimension, f."key", f."value", a.n from (select * from facets where until is null) f full join (select lens, dimension, "key", count(*) as n from assert_v where ord % 2 = 0 group by lens, dimension, "key") a on a.lens = f.lens and a.dimension = f.dimension and a."key" = f."key"')
def facet_join(spark, d):
    asserts = assert_v(spark, d)
    now = history.version_islands(asserts).where("until is null").select("lens", "dimension", "key", "value")
    new = asserts.where("ord % 2 = 0").groupBy("lens", "dimension", "key").agg(F.count("*").alias("n"))
    return now.join(new, ["lens", "dimension", "key"], "left")


@query("F9_well_formed", "select obs_id from assert_v where trim(dimension) <> '' and trim(\"key\") <> '' and trim(\"value\") <> ''")
def formed(spark, d):
    return assert_v(spark, d).where(history.well_formed(F.col("dimension"), F.col("key"), F.col("value"))).select("obs_id")


@query(
    "W3_size_windows",
    """recursive n as (select lens, seq, strlen(observation) as size, row_number() over (partition by lens order by seq) as nth from obs_v),
w(lens, nth, seq, size, total, win) as (
  select lens, nth, seq, size, size, 0 from n where nth = 1
  union all
  select n.lens, n.nth, n.seq, n.size, case when w.total > 0 and w.total + n.size > 16000 then n.size else w.total + n.size end, w.win + case when w.total > 0 and w.total + n.size > 16000 then 1 else 0 end
  from w join n on n.lens = w.lens and n.nth = w.nth + 1)
select lens, seq, size, win as \"window\" from w""",
)
def windows(spark, d):
    obs = obs_v(spark, d).select("lens", "seq", F.octet_length("observation").cast("long").alias("size"))
    return history.size_windows(obs, "lens", "seq", F.col("size"), 16_000)


@query("X9_Q6_summary_input", _VERSIONS + " select lens, concat('LENS: ', lens, chr(10), chr(10), 'FACETS (dimension/key, confidence, value):', chr(10), string_agg(printf('- %s/%s (%.2f): %s', dimension, \"key\", confidence, \"value\") || chr(10), '' order by dimension, \"key\")) as text from facets where until is null group by lens")
def summaries(spark, d):
    return text.summary_input(history.version_islands(assert_v(spark, d)).where("until is null"))


@query("X4_summary_signature", _VERSIONS + " select lens, sha256(concat('model', chr(0), 'prompt', chr(0), lens, count(*)::varchar)) as signature from facets where until is null group by lens")
def summary_signatures(spark, d):
    rows = history.version_islands(assert_v(spark, d)).where("until is null").groupBy("lens").agg(F.count("*").alias("n"))
    return rows.select("lens", X.summary_signature(F.lit("model"), F.lit("prompt"), F.concat("lens", F.col("n").cast("string"))).alias("signature"))


@query("U5_orphan_profiles", "select p.lens from (values ('default'), ('gone'), ('unified')) p(lens) where p.lens <> 'unified' and not exists (select 1 from assert_v a where a.lens = p.lens)")
def orphan_profiles(spark, d):
    profiles = spark.sql("select * from values ('default'), ('gone'), ('unified') as t(lens)")
    return profiles.where("lens <> 'unified'").join(assert_v(spark, d).select("lens"), "lens", "left_anti")


@query("O6_arcs_to_verify")
def arcs_to_verify(spark, d):
    seen = spark.sql("select * from values ('none', 0L) as t(signature, members)")
    return arcs.to_verify(candidate_arcs(spark, d), seen, 5)


_NOTE = "select dimension as arc, printf('CANDIDATE ARC: %d observations, %d sessions, %d days (%s..%s).', count(*), count(distinct session), count(distinct case when ts <> '' then substr(ts, 1, 10) end), substr(min(ts) filter (ts <> ''), 1, 10), substr(max(ts) filter (ts <> ''), 1, 10)) || ' Of these, 25% are cited by the facet d|k already.' as note from obs_v group by dimension"


@query("X12_arc_notes", _NOTE)
def arc_notes(spark, d):
    told = arcs.describe_arcs(obs_v(spark, d).withColumn("arc", F.col("dimension")))
    return told.select("arc", text.arc_note(F.col("n"), F.size("sessions"), F.col("days"), F.col("span_from"), F.col("span_to"), F.lit(0.25), F.lit("d|k")).alias("note"))
