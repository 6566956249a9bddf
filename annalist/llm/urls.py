"""URL filters with redirect equivalence, in DataFrame operations only.

A rule (action, host, path) fits its host, all subdomains, and paths that start
with its path; the longest fitting rule decides. A page that no rule fits takes
the decision of its aliases: pages are one alias group when redirects, canonical
links or refresh headers connect them, directly or over others. In such a group
an explicit allow takes precedence over a block; a group without either, and a
page without links, is allowed.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; a null html has no links; links that point to the
page itself or to nothing count as none; repeated rows each get a verdict;
columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule list is compiled into one expression up to this many rules.
MAX_RULES = 1000


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What makes two urls the same page: host, path (``/`` if empty) and query;
    null where there is no host."""
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def _targets(html: Column) -> Column:
    """The targets of canonical links and refresh headers in a page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b[^>]*\brel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)),
        F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*['"]?([^"'>\s]+)""", 0)),
    )
    bare = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"""(?is)^\w+\s*=\s*["']?|["']$""", ""), "&amp;", "&"))
    return F.filter(F.transform(bare, F.trim), lambda t: t != "")


def _absolute(url: Column, target: Column) -> Column:
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.rlike(r"^[#?]"), F.concat(site, path_of(url), target))
        .when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(u, v) node pairs of canonical links and refresh headers."""
    hop = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", F.explode(_targets(F.col("html"))).alias("target"))
    return hop.select(node_of(F.col("url")).alias("u"), node_of(_absolute(F.col("url"), F.col("target"))).alias("v"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, aliased. ``redirects`` may hold more
    (src, dst) urls, such as those of a crawl log."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(rows)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v")))
    links = materialise(links.where(F.col("u") != F.col("v")).distinct(), "links")
    judged = (
        rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
        .withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    )
    if links.isEmpty():
        verdict = judged.withColumn("inherited", F.lit(None).cast("string"))
    else:
        of = materialise(components(links), "aliases")
        url = F.concat(F.lit("x://"), F.col("node"))
        decided = of.withColumn("action", matching_rule(host_of(url), path_of(url), rules)["action"])
        groups = decided.groupBy("component").agg(F.max(F.when(F.col("action") == "allow", 2).when(F.col("action") == "block", 1)).alias("top"))
        inherits = decided.where(F.col("action").isNull()).join(groups, "component").select("node", F.when(F.col("top") == 2, "allow").when(F.col("top") == 1, "block").alias("inherited"))
        verdict = judged.join(inherits.where(F.col("inherited").isNotNull()), "node", "left")
    return verdict.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.action"), F.col("inherited"), F.lit("allow")).alias("verdict"),
        F.col("inherited").isNotNull().alias("aliased"),
    )


#: The same verdicts in DuckDB's dialect; alias groups by a recursive query.
ORACLE_SQL = r"""
with recursive p as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages
), h as (
  select page_id, url, html,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from p
), n as (
  select *, case when host <> '' then host || case when path = '' then '/' else path end || regexp_extract(url, '(?s)^[^#]*?(\?[^#]*)', 1) end as node from h
), t as (
  select node, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as target from n
), e as (
  select node as u, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || case when regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) end
    || regexp_extract(target, '(?s)^[^#]*?(\?[^#]*)', 1) as v from t where contains(target, '://')
), b as (select u, v from e where u <> v union select v, u from e where u <> v),
reach as (select u as node, u as other from b union select r.node, b.v from reach r join b on b.u = r.other),
rules(action, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit as (
  select node, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(action, length(rh || rp)) as action
  from (select distinct node, host, path from n where node is not null union
        select distinct v, regexp_extract(v, '^([^/]*)', 1), regexp_extract(v, '^[^/]*([^?]*)', 1) from b) q
  join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by node
), inherited as (
  select r.node, case when bool_or(f.action = 'allow') then 'allow' when bool_or(f.action = 'block') then 'block' end as verdict
  from reach r join fit f on f.node = r.other where r.node not in (select node from fit) group by r.node
)
select n.page_id, n.host, n.path, f.rule, coalesce(f.action, i.verdict, 'allow') as verdict, i.verdict is not null as aliased
from n left join fit f on f.node = n.node left join inherited i on i.node = n.node
"""
