"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and limits that stored data and callers rely on.
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"
BACKOFF_BASE_MINUTES, BACKOFF_CAP_MINUTES = 5, 360
LIMITS = {"observation": 2000, "evidence": 2000, "dimension": 100, "lens": 100, "query": 8000}
STAGED_PER_SESSION, STAGED_TOTAL = 200, 5000
DEFAULT_LENS, DEFAULT_K = "default", 8
PLATFORM_PREFIXES = {"opencode": "opencode:", "file": "file:"}
DEFAULT_PLATFORM = "claude"


def _nul() -> Column:
    return F.char(F.lit(0))


def obs_id(session: Column, lens: Column, text: Column) -> Column:
    """Content-addressed observation id."""
    return F.concat(F.lit("obs_"), F.substring(F.sha1(F.concat_ws("|", session, lens, text)), 1, 12))


def record_key(record_id: Column, text: Column) -> Column:
    """Identity of an ingested record: id and content, or content alone."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    trimmed = F.trim(F.coalesce(record_id, F.lit("")))
    return F.when(trimmed != "", F.concat(trimmed, F.lit(":"), F.substring(digest, 1, 16))).otherwise(F.concat(F.lit("h:"), F.substring(digest, 1, 32)))


def id_of_record_key(key: Column) -> Column:
    """What stands before the last colon; null for content keys and malformed ones."""
    found = F.regexp_extract(key, r"(?s)^(.+):[^:]*$", 1)
    return F.when((found != "") & (found != "h"), found)


def message_key(message_id: Column, role: Column, text: Column) -> Column:
    return F.concat(message_id, F.lit(":"), F.substring(F.sha2(F.concat(role, _nul(), text), 256), 1, 16))


def arc_signature(lens: Column, ids: Column) -> Column:
    return F.substring(F.sha2(F.concat(lens, _nul(), F.array_join(F.array_sort(ids), ",")), 256), 1, 24)


def summary_signature(model: Column, prompt: Column, facets: Column) -> Column:
    return F.sha2(F.concat(model, _nul(), prompt, _nul(), facets), 256)


def parsed_ts(ts: Column) -> Column:
    """A timestamp out of the accepted layouts; null for anything else."""
    text = F.trim(ts)
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?)?$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(shaped, text.try_cast("timestamp"))


def rfc3339(ts: Column) -> Column:
    """A timestamp as text. Java's patterns put a sign before years beyond 9999, which
    the format has none of."""
    return F.ltrim(F.date_format(ts, RFC3339), F.lit("+"))


def normal_ts(ts: Column, fallback: Column) -> Column:
    """RFC 3339 in UTC and whole seconds, else ``fallback``."""
    return F.coalesce(rfc3339(parsed_ts(ts)), fallback)


def millis_ts(ms: Column) -> Column:
    return F.when(ms > 0, rfc3339(F.timestamp_millis(ms))).otherwise("")


def backoff_minutes(retries: Column) -> Column:
    """Five minutes, doubled with each retry, up to six hours."""
    steps = F.least(F.greatest(retries, F.lit(1)) - 1, F.lit(30))
    return F.least(F.lit(BACKOFF_BASE_MINUTES) * F.pow(F.lit(2.0), steps), F.lit(float(BACKOFF_CAP_MINUTES)))


def ready(next_attempt: Column, now: Column) -> Column:
    return (F.coalesce(next_attempt, F.lit("")) == "") | (next_attempt <= now)


def backed_off(next_attempt: Column, now: Column) -> Column:
    return F.coalesce(parsed_ts(next_attempt) > parsed_ts(now), F.lit(False))


def platform_of(session: Column, stored: Column) -> Column:
    """The stored platform if it is a known one, else the session's prefix, else the default."""
    out = F.when(stored.isin(DEFAULT_PLATFORM, *PLATFORM_PREFIXES), stored)
    for name, prefix in PLATFORM_PREFIXES.items():
        out = out.when(session.startswith(prefix), F.lit(name))
    return out.otherwise(DEFAULT_PLATFORM)


def safe_name(name: Column) -> Column:
    text = F.trim(name)
    return F.regexp_replace(F.when(text == "", F.lit("unknown")).otherwise(text), r"[^A-Za-z0-9_-]", "_")


def reserved_name(name: Column) -> Column:
    return F.lower(safe_name(name)) == "unified"


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def merged_ids(a: Column, b: Column) -> Column:
    """Ids of both lists in order, each once, without empty ones."""
    return F.array_distinct(F.filter(F.concat(a, b), lambda x: x != ""))


def has_prefix(new: Column, old: Column) -> Column:
    return (F.size(new) >= F.size(old)) & (F.slice(new, 1, F.size(old)) == old)


def short_date(ts: Column) -> Column:
    return F.substring(ts, 1, 10)


def rendered(role: Column, text: Column) -> Column:
    """A turn in a transcript."""
    return F.concat(F.upper(role), F.lit(": "), text, F.lit("\n\n"))


def transcript_digest(turns: Column) -> Column:
    """Identity of a transcript: the digest of its (role, text) entries in order."""
    return F.sha2(F.to_json(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))), 256)


def fenced(text: Column, token: str = "corpus:untrusted") -> Column:
    """The text between fixed delimiters, the token within it defused in any case."""
    first, second = token.split(":")
    inner = F.regexp_replace(text, f"(?i)({first}):({second})", "$1_$2")
    return F.concat(F.lit(f"<<<{token}\n"), inner, F.lit(f"\n{token}>>>"))


def preview(text: Column, limit: int = 88) -> Column:
    """The trimmed text, or its first ``limit`` - 1 bytes and an ellipsis; a character
    cut in two becomes U+FFFD."""
    t = F.trim(text)
    cut = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, limit - 1).cast("string"))
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def k_band(n: int) -> list[int]:
    """Neighbour counts over which a pattern must persist."""
    if n < 3:
        return [1]
    high = min((n - 1).bit_length(), n - 1)
    return list(range(min(2, high), high + 1))


def current_version(versions: Column) -> Column:
    """The last version that is open."""
    return F.try_element_at(F.filter(versions, lambda v: v["valid_to"] == ""), F.lit(-1))


def too_long(column: Column, limit: int) -> Column:
    """Limits are in bytes."""
    return F.octet_length(column) > limit


def any_of(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out
