"""The pipelines around the model: mining, review, emergence and profiles."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_array
from ..functions.scalars import summary_signature
from ..operators import arcs, history, models, queue, text
from ..operators.tables import upsert
from ..scratch import discard, materialise
from ..store import SCHEMAS, Store

Model = models.Model


def pretty(value: object) -> str:
    """JSON as the models read it; the sizes of windows count its bytes."""
    return json.dumps(value, indent=2, ensure_ascii=False)


@dataclass
class Pace:
    """How a run goes on from pass to pass: how many tasks call models at a time
    (``window``; 0: as many as the cluster runs), the characters that one task
    should hold, what was tried, and how many sessions the last pass tried. A pass
    of which half of the window wasn't served in time halves it; it never widens
    again."""

    window: int = 0
    budget: int = 2_000_000
    attempts: DataFrame | None = None
    tried: int = 0

    def tasks(self, chars: int, cores: int) -> int:
        """Tasks for so many characters: the window, or enough of them for the budget."""
        return self.window or max(cores, -(-chars // self.budget), 1)

    def starved(self, sessions: int, cores: int) -> None:
        width = self.window or cores
        if width > 1 and sessions >= (width + 1) // 2:
            self.window = width // 2


def unattempted(ready: DataFrame, totals: DataFrame, lens: str, attempts: DataFrame | None) -> DataFrame:
    """session, lens, n of the ready sessions that no earlier pass has tried at their
    present length: one that failed is tried once a run, one that grew again."""
    keys = ready.join(totals.select("session", "n"), "session").select("session", F.lit(lens).alias("lens"), "n")
    return keys if attempts is None else keys.join(attempts, ["session", "lens", "n"], "left_anti")


def drain(store: Store, lenses: Sequence[str], model: Callable[[str], Model], now: str, chunk_chars: int = 0, since: str | None = None, until: str | None = None, pace: Pace | None = None) -> int:
    """Mine what is pending for each lens and wasn't tried before in the run that
    ``pace`` is of; the number of (session, lens) marks set.
    Chunks are mined in the tasks; a session whose chunk failed or was truncated
    keeps its watermark and gets a retry later; every drifted one is stamped and counted."""
    done, pace = 0, pace or Pace()
    pace.tried, before = 0, pace.attempts
    cores = store.spark.sparkContext.defaultParallelism
    for lens in lenses:
        raw, progress = store.read("raw"), store.read("progress")
        totals = queue.session_totals(raw)
        ready = queue.pending_sessions(raw, store.read("staged"), progress, [lens], now, since, until)
        keys = materialise(unattempted(ready, totals, lens, before), "attempts")
        size = keys.join(totals.select("session", "chars"), "session").agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
        if not size["n"]:
            continue
        pace.tried += size["n"]
        pace.attempts = keys if pace.attempts is None else pace.attempts.unionByName(keys)
        tail = queue.lens_tail(raw.join(keys.select("session"), "session", "left_semi"), progress, [lens])
        chunks = text.chunks(tail, chunk_chars).repartition(pace.tasks(size["chars"], cores), "session")
        mined = materialise(models.mine(chunks, model(lens), lens), "mined")
        outcome = models.session_outcomes(mined)
        good = outcome.where("not failed")
        marks = good.join(totals, "session").select("session", F.lit(lens).alias("lens"), F.col("n").cast("int").alias("distilled"), F.col("max_id").alias("raw_high_id"), "drifted")
        rows = mined.where("observation is not null").join(good, "session", "left_semi").join(totals.select("session", F.col("last_ts").alias("ts")), "session")
        rows = rows.select("obs_id", "ts", "session", "lens", "dimension", "observation", "evidence", F.col("poignancy").cast("int").alias("poignancy"), F.lit("mined").alias("source"), F.col("embedding").cast("array<float>").alias("embedding"))
        done += store.commit_distillation(rows, marks, now)
        failed = outcome.where("failed").select("session", F.lit(lens).alias("lens"), "starved")
        late = failed.agg(F.count("*").alias("n"), F.count(F.when(F.col("starved"), 1)).alias("starved")).first()
        if late["n"]:
            store.update(lambda s, failed=failed: {"progress": queue.retries_after_failure(s.read("progress"), failed, now)})
            pace.starved(late["starved"], cores)
    return done


def _cited(item: dict) -> list[str]:
    """All ids that an assertion gives as evidence, or one that is none."""
    ids = item.get("because_of") or []
    return [str(i) for i in (ids if isinstance(ids, list) else [ids])] or [""]


def _delta(store: Store, lens: str, after: int) -> DataFrame:
    """The lens's observations past a cursor, as the models read them."""
    return store.read("observations").where((F.col("lens") == lens) & (F.col("seq") > after)).drop("embedding")


def _cursor(store: Store, lens: str) -> int:
    return int(store.get(f"review_rowid:{lens}", "0") or 0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from b.slice(at, 256).to_pylist()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        told = [(r["lens"], r["seq"], len(pretty(r).encode())) for r in _rows(iter([b]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*told, strict=True) if told else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lens", "seq", "size"])


def _window_ends(store: Store, lens: str, after: int, window_bytes: int) -> list[int]:
    """The last seq of each window past a cursor, in order. Only seqs and sizes are sorted."""
    sizes = _delta(store, lens, after).mapInArrow(_sizes, "lens string, seq long, size long")
    windows = history.size_windows(sizes, "lens", "seq", F.col("size"), window_bytes)
    return sorted(r["seq"] for r in windows.groupBy("window").agg(F.max("seq").alias("seq")).select("seq").collect())


_REPLY = "status string, lens string, dimension string, key string, value string, confidence double, obs_id string, ord long, contradicts boolean"


def _asked(lens: str, model: Model):
    """For mapInArrow, in one task: a page (in the column ``_page``) and a window of
    rows in order to the model; its assertions, and first a row of the reply's status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, page = [], ""
        for r in _rows(batches):
            head = r.pop("_page")
            if head is None:  # pretty() of the list of rows, a row at a time
                parts += [",\n  " if parts else "\n[\n  ", pretty(r).replace("\n", "\n  ")]
            else:
                page = head
        parts += ["\n]" if parts else "\n[]"]
        parts.insert(0, page)
        whole = ["".join(parts)]
        parts.clear()
        rows: list[tuple] = []
        try:
            reply = [model(whole.pop())]
        except Exception as e:  # whatever a model raises
            status = f"model of lens {lens}: {e}"
        else:
            status, items = parse_array(reply.pop())
            status = f"reply of lens {lens}: {status}" if status in ("truncated", "none") else ""
            try:
                rows = [
                    ("", lens, *(str(x.get(f) or "") for f in ("dimension", "key", "value")), float(x.get("confidence") or 0), obs_id, k << 20 | i, bool(x.get("contradicts_prior")))
                    for k, x in enumerate(items) for i, obs_id in enumerate(_cited(x))
                ]
                for r in rows:
                    "".join((*r[2:5], r[6])).encode()
            except (TypeError, ValueError, OverflowError) as e:  # a confidence that is no number, half a character
                status, rows = f"reply of lens {lens}: {e}", []
        rows.insert(0, (status.encode("utf-8", "replace").decode(), *[None] * 8))
        types = (*[pa.string()] * 5, pa.float64(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["status", "lens", "dimension", "key", "value", "confidence", "obs_id", "ord", "contradicts"])

    return run


def _folded(store: Store, lens: str, model: Model, after: int, end: int, now: str) -> DataFrame:
    """The facets of all lenses after a window, the observations past ``after`` and up
    to ``end``, went to the model of one. The model reads it in a task."""
    versions = store.read("facet_versions")
    own = versions.where((F.col("lens") == lens) & (F.col("valid_to") == ""))
    page = text.summary_input(own).select(F.lit(-1).cast("long").alias("seq"), F.col("text").alias("_page"))
    window = _delta(store, lens, after).where(F.col("seq") <= end).unionByName(page, allowMissingColumns=True)
    told = materialise(window.repartition(1).sortWithinPartitions("seq").mapInArrow(_asked(lens, model), _REPLY), "reply")
    status = told.where(F.col("lens").isNull()).first()["status"]
    if status:
        discard(told)
        raise ValueError(status)
    out = history.apply_assertions(versions, told.where(F.col("lens").isNotNull()).drop("status"), now).select(*versions.columns)
    out._reply = told
    return out


def review(store: Store, lens: str, model: Model, now: str, window_bytes: int = 16_000) -> int:
    """Fold the observations past the lens's cursor, window after window: each
    window is bounded by ``window_bytes``, sees the facets that the one before left,
    and moves the cursor with its own commit. The number of windows."""
    windows, at = 0, _cursor(store, lens)
    while ends := _window_ends(store, lens, at, window_bytes):
        for end in ends:
            folded = _folded(store, lens, model, at, end, now)
            meta = store.spark.createDataFrame([(f"review_rowid:{lens}", str(end)), ("review_ts", now)], SCHEMAS["meta"])
            store.update(lambda s, folded=folded, meta=meta: {"facet_versions": folded, "meta": upsert(s.read("meta"), meta, "key")})
            discard(folded._reply)
            windows, before, at = windows + 1, end, _cursor(store, lens)
            if at != before:  # moved by another: windows follow anew from there
                break
    return windows


def preview_review(store: Store, lens: str, model: Model, now: str, window_bytes: int = 16_000) -> DataFrame:
    """The lens's facets as its next window would leave them; nothing is stored."""
    at = _cursor(store, lens)
    ends = _window_ends(store, lens, at, window_bytes)
    after = _folded(store, lens, model, at, ends[0], now) if ends else store.read("facet_versions")
    return after.where(F.col("lens") == lens)


def emerge(store: Store, lens: str, judge: Model, now: str, budget: int = 5) -> int:
    """Candidate arcs that weren't judged yet, best first, to the judge with all
    their members; the first well-formed facet of a reply becomes assertions. Arcs are marked as seen once their outcome is stored."""
    obs = store.read("observations")
    versions = store.read("facet_versions")
    cited = versions.select("lens", "dimension", "key", F.explode("because_of").alias("obs_id"))
    seen = store.read("meta").where(F.col("key").startswith(f"emerge_seen:{lens}:"))
    seen = seen.select(F.element_at(F.split("key", ":"), -1).alias("signature"), F.get_json_object("value", "$.members").cast("long").alias("members"))
    chosen = arcs.to_verify(arcs.candidates(obs, cited, lens), seen, budget).collect()
    accepted, marks = [], {}
    for arc in chosen:
        told = obs.where(F.col("obs_id").isin(list(arc["ids"]))).select("obs_id", "dimension", "observation").orderBy("obs_id").collect()
        status, items = parse_array(judge(json.dumps({"n": arc["n"], "coverage": arc["coverage"], "facet": arc["facet"], "observations": [r.asDict() for r in told]})))
        if status in ("truncated", "none"):
            continue
        facets = [x for x in items if all(str(x.get(f) or "").strip() for f in ("dimension", "key", "value"))]
        for x in facets[:1]:
            accepted += [(lens, str(x.get("dimension") or ""), str(x.get("key") or ""), str(x.get("value") or ""), float(x.get("confidence") or 0), i, len(accepted) + k, False) for k, i in enumerate(arc["ids"])]
        marks[f"emerge_seen:{lens}:{arc['signature']}"] = json.dumps({"outcome": "accepted" if facets else "rejected", "members": arc["n"]})
    if accepted:
        asserts = store.spark.createDataFrame(accepted, "lens string, dimension string, key string, value string, confidence double, obs_id string, ord long, contradicts boolean")
        store.update(lambda s: {"facet_versions": history.apply_assertions(s.read("facet_versions"), asserts, now)})
    if marks:
        store.set(marks)
    return len(marks)


def summarise(store: Store, model: Model, prompt: str = "", model_name: str = "") -> list[str]:
    """Write the profile of each lens whose facets changed; drop profiles of lenses
    without facets. The lenses written."""
    now = store.read("facet_versions").where("valid_to = ''")
    pages = text.summary_input(now).withColumn("signature", summary_signature(F.lit(model_name), F.lit(prompt), F.col("text")))
    old = store.read("profiles").select("lens", F.col("signature").alias("before"))
    dirty = pages.join(old, "lens", "left").where(~F.col("signature").eqNullSafe(F.col("before"))).orderBy("lens").collect()
    written = []
    for r in dirty:
        # A lens whose model fails keeps the profile that it has; the others go on.
        try:
            store.write_profile(r["lens"], model(r["text"]), r["signature"])
            written.append(r["lens"])
        except Exception as e:  # whatever a model raises
            store.set({f"profile_error:{r['lens']}": str(e)})
    there = pages.select("lens")
    gone = store.read("profiles").where("lens <> 'unified'").join(there, "lens", "left_anti")
    if not gone.isEmpty():
        store.update(lambda s: {"profiles": s.read("profiles").join(gone.select("lens"), "lens", "left_anti")})
    # The unified profile follows the pages of all lenses.
    whole = "\n".join(r["text"] for r in pages.select("lens", "text").orderBy("lens").collect())
    if not whole:
        store.delete_profile("unified")
        return written
    told = store.spark.createDataFrame([(whole,)], "text string").select(summary_signature(F.lit(model_name), F.lit(prompt), F.col("text")).alias("s")).first()["s"]
    have = store.read("profiles").where("lens = 'unified'").select("signature").first()
    if have is None or have["signature"] != told:
        try:
            store.write_profile("unified", model(whole), told)
        except Exception as e:
            store.set({"profile_error:unified": str(e)})
    return written


__all__ = ["drain", "emerge", "preview_review", "review", "summarise"]
