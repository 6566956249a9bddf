"""The engine's surface: what its commands and tools do, as methods."""

from __future__ import annotations

import json
import math
import shutil
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import replace
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import DEFAULT_K, DEFAULT_LENS, LIMITS, STAGED_PER_SESSION, STAGED_TOTAL
from .operators import arcs, ingest, models, queue, runners, text, vectors
from .operators.runners import Runner, RunnerDown, RunnerSet
from .plans import distill
from .sources import session_db, settings
from .store import Store

Model = models.Model
#: How long a run waits for a backoff to end.
WAIT_SECONDS = 15 * 60


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Engine:
    """One archive with its lenses, models and embedder. ``models`` maps a lens to
    its model; the entry ``""`` serves lenses without one of their own."""

    def __init__(self, spark: SparkSession, root: str, models_by_lens: Mapping[str, Model] | None = None, embed: Callable[[str], list[float]] = models.hash_embedder, lens_folder: str | Path | None = None, clock: Callable[[], str] = utc_now, runners: Mapping[str, Runner] | None = None, environment: Mapping[str, str] | None = None) -> None:
        """``runners`` by name take the place of ``models_by_lens``; ``environment`` gives
        the scoped settings that neither a lens nor the archive names."""
        self.spark, self.store, self.embed, self.clock = spark, Store(spark, root), embed, clock
        self.models = dict(models_by_lens or {"": models.echo_miner})
        self.runners, self.environment = runners, dict(environment or {})
        self.lens_folder = Path(lens_folder) if lens_folder else None
        self._open: RunnerSet | None = None
        self.store.migrate()

    # -- settings and lenses ----------------------------------------------
    def settings(self) -> settings.Settings:
        told = settings.parse_settings(self.store.get("settings"))
        return replace(told, **{k: self.environment.get(k, "") for k in settings.SCOPED if not getattr(told, k)})

    def config_get(self, key: str, lens: str = "") -> str:
        """A scoped setting as it holds: a lens's own, else the archive's, else the
        environment's. Other keys have the archive's scope alone."""
        key = settings.canonical_key(key)
        if lens and key in settings.SCOPED:
            if own := str(settings.lens_spec(self._folder_of(lens)).get(settings.LENS_FIELDS[key]) or "").strip():
                return own
        now = self.settings()
        if key == "lens":
            return ",".join(now.lenses)
        return str(getattr(now, key)) if hasattr(now, key) and key != "other" else now.other.get(key, "")

    def config_set(self, key: str, value: str, lens: str = "") -> None:
        """Set a key in the archive's scope, or a scoped one in a lens's. An empty
        value unsets it."""
        key = settings.canonical_key(key)
        if lens:
            if key not in settings.SCOPED:
                raise ValueError(f"a lens has no setting {key}")
            folder = self._folder_of(lens)
            spec = settings.lens_spec(folder) | {settings.LENS_FIELDS[key]: value.strip()}
            settings.write_lens(folder, {k: v for k, v in spec.items() if v}, {})
        elif value.strip():
            self.set_setting(key, value.strip())
        else:
            self.store.set({"settings": settings.unset_key(self.store.get("settings"), key)})

    def config_unset(self, key: str, lens: str = "") -> None:
        self.config_set(key, "", lens)

    def config_list(self, lens: str = "") -> dict[str, str]:
        keys = settings.SCOPED if lens else (*settings.SCOPED, *settings.COUNTS, "lens", *self.settings().other)
        return {k: self.config_get(k, lens) for k in keys}

    def config_path(self, lens: str = "") -> str:
        """Where a scope is kept."""
        return str(self._folder_of(lens) / "lens.json") if lens else f"{self.store.root}/meta"

    def set_setting(self, key: str, value: str) -> None:
        self.store.set({"settings": settings.set_key(self.store.get("settings"), key, value)})

    def lenses(self) -> tuple[str, ...]:
        """The enabled lenses; the default one if none is named."""
        return self.settings().lenses or (DEFAULT_LENS,)

    def enable(self, lens: str) -> None:
        if lens not in self.settings().lenses:
            self.store.set({"settings": self.store.get("settings") + f"lens = {lens}\n"})

    def disable(self, lens: str) -> None:
        kept = [x for x in self.store.get("settings").splitlines() if [p.strip() for p in x.partition("=")[::2]] != ["lens", lens]]
        self.store.set({"settings": "\n".join(kept) + "\n" * bool(kept)})

    def register(self, folder: str | Path) -> settings.Lens:
        """Copy a lens folder into the registry, whole or not at all; names that are
        reserved or taken (in any case) are refused."""
        lens = settings.load_lens(folder)
        if self.lens_folder is None:
            raise ValueError("this engine has no lens folder")
        if lens.name.lower() in {x.name.lower() for x in self.registered()}:
            raise ValueError(f"{lens.name} is registered")
        self.lens_folder.mkdir(parents=True, exist_ok=True)
        beside = self.lens_folder / f".{lens.name}.new"
        shutil.rmtree(beside, ignore_errors=True)
        shutil.copytree(folder, beside)
        beside.rename(self.lens_folder / lens.name)
        return lens

    def deregister(self, lens: str) -> None:
        if self.lens_folder is not None:
            shutil.rmtree(self._folder_of(lens))

    def _folder_of(self, lens: str) -> Path:
        """The folder of a registered lens."""
        for p in sorted(self.lens_folder.iterdir()) if self.lens_folder and self.lens_folder.exists() else []:
            if p.is_dir() and not p.name.startswith(".") and settings.load_lens(p).name == lens:
                return p
        raise ValueError(f"{lens} isn't registered")

    def update_lens(self, folder: str | Path) -> settings.Lens:
        """Put a folder in the place of the registered lens of its name; a failure
        leaves the old one."""
        lens = settings.load_lens(folder)
        old = self._folder_of(lens.name)
        new, before = old.parent / f".{old.name}.new", old.parent / f".{old.name}.old"
        for x in (new, before):
            shutil.rmtree(x, ignore_errors=True)
        shutil.copytree(folder, new)
        old.rename(before)
        try:
            new.rename(old)
        except OSError:
            before.rename(old)
            raise
        shutil.rmtree(before)
        return lens

    def show(self, lens: str) -> dict:
        """A registered lens's definition, and what the archive holds of it."""
        x = settings.load_lens(self._folder_of(lens))
        count = lambda t, seen: self.store.read(t).where(F.col("lens") == lens).select(*seen).distinct().count()
        return {
            "name": x.name, "dimensions": list(x.dimensions), "prompts": sorted(x.prompts), "enabled": lens in self.lenses(),
            "runner": self.config_get("runner", lens), "mine_model": self.config_get("mine_model", lens), "review_model": self.config_get("review_model", lens),
            "observations": count("observations", ["obs_id"]), "facets": count("facet_versions", ["dimension", "key"]), "sessions": count("progress", ["session"]),
        }

    def try_lens(self, where: str, model: Model | None = None, sessions: Sequence[str] | None = None) -> DataFrame:
        """What a lens would mine of the whole log (or of some sessions): one that is
        registered, or a folder that isn't. Nothing is stored, so a reserved name does no harm."""
        try:
            lens = settings.load_lens(self._folder_of(where))
        except ValueError:
            lens = settings.load_lens(where, "candidate")
        raw = self.store.read("raw")
        raw = raw if sessions is None else raw.where(F.col("session").isin(list(sessions)))
        tail = queue.lens_tail(raw, self.store.read("progress").where(F.lit(False)), [lens.name])
        return models.mine(text.chunks(tail, self.settings().chunk_max_chars), model or self.model(lens.name), lens.name, self.embed)

    def load_default(self) -> None:
        """Register and enable the lens that an archive begins with."""
        if self.lens_folder is not None and DEFAULT_LENS not in {x.name for x in self.registered()}:
            settings.write_lens(self.lens_folder / DEFAULT_LENS, {"name": DEFAULT_LENS, "dimensions": list(settings.DIMENSIONS)}, settings.DEFAULT_PROMPTS)
        self.enable(DEFAULT_LENS)

    def seed(self, declined: bool = False) -> str:
        """Decide once in an archive's life whether it gets the default lens: an empty
        archive without lenses does, and one with data or a registration of it. What
        was decided stays, so a lens that is removed doesn't come back."""
        if decided := self.store.get("default_lens"):
            return decided
        names = {x.name for x in self.registered()}
        known = lambda: not self.store.read("progress").where(F.col("lens") == DEFAULT_LENS).isEmpty()
        empty = lambda: self.store.read("raw").isEmpty() and self.store.read("progress").isEmpty()
        decided = "declined" if declined else "done" if DEFAULT_LENS in names or known() or (not names and empty()) else "not needed"
        if decided == "done":
            self.load_default()
        self.store.set({"default_lens": decided})
        return decided

    def registered(self) -> list[settings.Lens]:
        if self.lens_folder is None or not self.lens_folder.exists():
            return []
        return [settings.load_lens(p) for p in sorted(self.lens_folder.iterdir()) if p.is_dir() and not p.name.startswith(".")]

    def definitions(self) -> list[settings.Lens]:
        """The enabled lenses' definitions; one that isn't registered has its name alone."""
        known = {x.name: x for x in self.registered()}
        return [known.get(x) or settings.Lens(x) for x in self.lenses()]

    def model(self, lens: str, phase: str = "mine") -> Model:
        """The model of a lens. Those of runners are there while the runners are open."""
        if self._open is not None:
            return self._open.model(lens, phase)
        return self.models.get(lens) or self.models[""]

    @contextmanager
    def _runners(self, *more: str) -> Iterator[None]:
        """The runners of the enabled lenses (and ``more``), opened around work."""
        if self.runners is None or self._open is not None:
            yield
            return
        known = {x.name: x for x in [*self.registered(), *self.definitions()]}
        needed = {x: known.get(x) or settings.Lens(x) for x in (*self.lenses(), *more)}
        with RunnerSet(self.runners, self.settings(), list(needed.values())) as opened:
            self._open = opened
            try:
                yield
            finally:
                self._open = None

    def pace(self) -> distill.Pace:
        """The window of a run: what the settings ask for, if they do; one call at a
        time for a runner that can't do more."""
        asked = "mine_concurrency" in {settings.canonical_key(x.partition("=")[0]) for x in self.store.get("settings").splitlines()}
        safe = self._open is None or self._open.concurrent
        cores = self.spark.sparkContext.defaultParallelism
        return distill.Pace(settings.concurrency(self.settings().mine_concurrency, cores, safe) if asked or not safe else 0)

    # -- the log -----------------------------------------------------------
    def ingest(self, path: str) -> dict[str, int]:
        """Merge an NDJSON file. Line numbers order a batch; they follow file order."""
        rows = self.spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
        return self.store.ingest_lines(rows, self.clock())

    def import_database(self, path: str, scratch: str = "", sessions: Sequence[str] | None = None) -> dict[str, int]:
        """Sessions of an editor's database changed since the last import (or the
        named ones): unchanged ones are skipped, grown ones appended to, others
        rewritten. A full import moves the high-water mark."""
        session_db.register(self.spark)
        since = 0 if sessions is not None else int(self.store.get("opencode_sync_time_updated_ms", "0") or 0)
        read = lambda t: self.spark.read.format("session_db").option("path", path).option("table", t).option("since", since).option("scratch", scratch).load()
        chosen = read("session")
        if sessions is not None:
            chosen = chosen.where(F.col("id").isin(list(sessions)))
        prefix = F.concat(F.lit("opencode:"), F.col("session"))
        turns = ingest.read_turns(read("message"), read("part")).join(chosen.select(F.col("id").alias("session")), "session", "left_semi").withColumn("session", prefix)
        order = F.struct("time_created", "message_id", "key", "role", "text", "ts")
        new = turns.groupBy("session").agg(F.array_sort(F.collect_list(order)).alias("turns")).withColumn("keys", F.transform("turns", lambda t: t["key"]))
        stored = self.store.read("meta").where(F.col("key").startswith("opencode_import_keys:")).select(F.expr("substring(key, 22)").alias("session"), F.from_json("value", "array<string>").alias("keys"))
        counts = self.store.read("raw").groupBy("session").agg(F.count("*").alias("n"))
        acts = ingest.reconcile(stored, counts, new.select("session", "keys"))
        done = {r["action"]: r["count"] for r in acts.groupBy("action").count().collect()}
        meta = chosen.select(F.concat(F.lit("opencode:"), "id").alias("session"), F.col("directory").alias("cwd"), F.lit(self.clock()).alias("started"), F.lit("opencode").alias("platform"))
        flat = new.join(acts, "session").select("session", "action", F.col("n_old").alias("n_old"), F.posexplode("turns").alias("seq", "t"))
        for action, replace in (("append", False), ("replace", True)):
            if done.get(action):
                rows = flat.where((F.col("action") == action) & (F.lit(replace) | (F.col("seq") >= F.col("n_old")))).select("session", "seq", "t.ts", "t.role", F.lit("").alias("effort"), "t.text")
                touched = acts.where(F.col("action") == action).select("session")
                keys = new.join(touched, "session").select(F.concat(F.lit("opencode_import_keys:"), "session").alias("key"), F.to_json("keys").alias("value"))
                self.store.import_sessions(rows, meta.join(touched, "session", "left_semi"), keys, replace)
        high = chosen.agg(F.max("time_updated")).first()[0]
        if sessions is None and high:
            self.store.set({"opencode_sync_time_updated_ms": str(high)})
        return done

    def cleanup(self, days: int = 90, confirm: bool = False) -> dict[str, int]:
        """Sessions and rows that are older; gone only if confirmed."""
        now = self._now()
        cutoff = (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ")
        row = queue.prune_before(self.store.read("raw"), cutoff).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        if confirm and row["sessions"]:
            self.store.prune(cutoff)
        return row.asDict()

    def export(self, target: str, force: bool = False) -> None:
        self.store.export(target, force)

    # -- observations --------------------------------------------------------
    def search(self, query: str, lens: str = DEFAULT_LENS, k: int = DEFAULT_K) -> DataFrame:
        query = query.strip()
        if not query or len(query.encode()) > LIMITS["query"]:
            raise ValueError("a query has 1 to 8000 bytes")
        vector = F.array(*map(F.lit, self.embed(query)))
        return vectors.search(self.store.read("observations"), vector, lens or DEFAULT_LENS, k if k > 0 else DEFAULT_K).drop("embedding")

    def render_search(self, query: str, lens: str = DEFAULT_LENS, k: int = DEFAULT_K) -> str:
        hits = self.search(query, lens, k)
        lines = hits.select(text.hit_line(F.col("ts"), F.col("dimension"), F.col("observation"), F.col("evidence"), F.col("obs_id")).alias("line")).collect()
        return "".join(r["line"] for r in lines) or f"No observations in the lens {lens}."

    def record(self, session: str, observation: str, dimension: str = "", evidence: str = "", lens: str = "", poignancy: int = 0) -> str:
        """Stage one observation: staged, duplicate or full."""
        told = {"session": session, "observation": observation, "dimension": dimension, "evidence": evidence, "lens": lens}
        told = {k: v.strip() for k, v in told.items()}
        if not told["session"] or not told["observation"]:
            raise ValueError("session and observation are needed")
        for name, limit in LIMITS.items():
            if len(told.get(name, "").encode()) > limit:
                raise ValueError(f"{name} is longer than {limit} bytes")
        told["lens"] = told["lens"] or DEFAULT_LENS
        if any(c in told["lens"] for c in "/\\") or ".." in told["lens"]:
            raise ValueError("a lens name is no path")
        told["poignancy"] = 5 if poignancy < 1 else min(10, poignancy)
        from .functions.scalars import obs_id

        staged = self.store.read("staged")
        row = self.spark.createDataFrame([told], "session string, observation string, dimension string, evidence string, lens string, poignancy int")
        row = row.withColumn("obs_id", obs_id(F.col("session"), F.col("lens"), F.col("observation")))
        payload = F.to_json(F.struct("obs_id", "session", "lens", "dimension", "observation", "evidence", "poignancy"))
        row = row.select(F.lit(self.store.next_id("staged")).cast("long").alias("id"), "session", "obs_id", "lens", payload.alias("payload"))
        if not row.join(staged, ["session", "obs_id"], "left_semi").isEmpty():
            return "duplicate"
        before = staged.count()
        self.store.stage(row, STAGED_PER_SESSION, STAGED_TOTAL)
        return "staged" if self.store.read("staged").count() > before else "full"

    def delete(self, obs_id: str) -> bool:
        return self.store.delete_observation(obs_id)

    # -- facets and profiles -------------------------------------------------
    def facets(self, lens: str = "", history: bool = False) -> DataFrame:
        rows = self.store.read("facet_versions")
        rows = rows.where(F.col("lens") == lens) if lens else rows
        return rows if history else rows.where("valid_to = ''")

    def profile(self, lens: str = "unified") -> str:
        row = self.store.read("profiles").where(F.col("lens") == lens).select("markdown").first()
        return row["markdown"] if row else ""

    # -- work ----------------------------------------------------------------
    def promote_staged(self) -> int:
        """Move staged observations into the log of observations, exactly once."""
        from .operators.tables import drain_staged

        staged = self.store.read("staged")
        through = staged.agg(F.max("id")).first()[0]
        if through is None:
            return 0
        embed = self.embed

        def with_vectors(batches):
            for b in batches:
                b["embedding"] = [embed(x) for x in b["observation"]]
                yield b

        rows = drain_staged(staged).select("obs_id", F.lit(self.clock()).alias("ts"), "session", "lens", "dimension", "observation", "evidence", "poignancy", F.lit("active").alias("source"))
        rows = rows.mapInPandas(with_vectors, "obs_id string, ts string, session string, lens string, dimension string, observation string, evidence string, poignancy int, source string, embedding array<float>")
        before = self.store.read("observations").count()
        self.store.add_observations(rows)
        self.store.update(lambda s: {"staged": s.read("staged").where(F.col("id") > through)})
        return self.store.read("observations").count() - before

    def run(self, since: str = "", until: str = "", wait_backoffs: bool = False, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
        """Drain what is pending, of sessions whose last turn is within the range, pass
        after pass while there is something that this run hasn't tried at its present
        length and no stop was asked for; then review, if due. ``wait_backoffs`` waits
        for backoffs that end within :data:`WAIT_SECONDS` and tries those anew."""
        now = self._now()
        between = [x.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if x else None for x in settings.time_range(since, until, now)]
        done = {"staged": self.promote_staged(), "mined": 0, "windows": 0}
        with self._runners():
            pace = self.pace()
            while True:
                if self.store.get("worker_stop_requested") == "1":
                    self.store.set({"worker_stop_requested": "0"})
                    break
                done["mined"] += distill.drain(self.store, self.lenses(), self.model, self.clock(), self.settings().chunk_max_chars, *between, pace)
                if pace.tried:
                    continue
                wait = self.next_wakeup() if wait_backoffs else None
                if wait is None or wait > WAIT_SECONDS:
                    break
                sleep(wait)
                pace.attempts = None
            if self.review_due():
                done["windows"] = self.review()
        return done

    def _now(self) -> datetime:
        return datetime.fromisoformat(self.clock().replace("Z", "+00:00"))

    def next_wakeup(self) -> float | None:
        """Seconds until the soonest backoff of an enabled lens ends, if one runs."""
        soonest = queue.next_backoff(self.store.read("progress"), self.lenses(), self.clock()).first()[0]
        return (datetime.fromisoformat(soonest.replace("Z", "+00:00")) - self._now()).total_seconds() if soonest else None

    def session_start(self, session: str, cwd: str = "", platform: str = "") -> None:
        """What the hook at a session's start stores: its folder and platform, once."""
        row = self.spark.createDataFrame([(session, cwd, self.clock(), platform)], "session string, cwd string, started string, platform string")
        self.store.record_meta(row)

    def kick(self) -> dict[str, int] | None:
        """What the hook at a session's end does: run if something is pending, staged
        or due for review."""
        s = self.store
        pending = queue.pending_sessions(s.read("raw"), s.read("staged"), s.read("progress"), self.lenses(), self.clock())
        return self.run() if not pending.isEmpty() or self.review_due() else None

    def stop(self) -> None:
        self.store.set({"worker_stop_requested": "1"})

    def review_due(self) -> bool:
        s = self.settings()
        last = self.store.get("review_ts")
        cursor = int(self.store.get("review_obs_rowid", "0") or 0)
        sessions = self.store.read("progress").where(F.col("distilled_at") > last).agg(F.countDistinct("session")).first()[0]
        weight = self.store.read("observations").where(F.col("seq") > cursor).agg(F.coalesce(F.sum("poignancy"), F.lit(0))).first()[0]
        return sessions >= s.review_every or (s.review_poignancy > 0 and weight >= s.review_poignancy)

    def review(self, full: bool = False) -> int:
        """Fold every lens. A lens that fails keeps its own cursor and the global
        stamp is withheld; the others' folds stand."""
        windows, failed = 0, []
        with self._runners():
            for lens in self.lenses():
                try:
                    windows += distill.review(self.store, lens, self.model(lens, "review"), self.clock(), self.settings().review_max_chars)
                    if full:
                        distill.emerge(self.store, lens, self.model(lens, "review"), self.clock())
                except (ValueError, RunnerDown):
                    failed.append(lens)
        if not failed:
            top = self.store.read("observations").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            self.store.set({"review_obs_rowid": str(top), "review_ts": self.clock()})
        return windows

    def summarise(self, prompt: str = "") -> list[str]:
        with self._runners():
            return distill.summarise(self.store, self.model("", "review"), prompt)

    def backfill(self, lens: str, fresh: bool = False) -> dict[str, int | bool]:
        """Read the whole log anew for one lens; ``fresh`` drops what it has first.
        It is complete if nothing of the lens is left pending or unreviewed."""
        self.store.delete_lens(lens) if fresh else self.store.reset_lens(lens)
        with self._runners(lens):
            pace, mined, windows = self.pace(), 0, 0
            while True:
                mined += distill.drain(self.store, [lens], self.model, self.clock(), self.settings().chunk_max_chars, pace=pace)
                if not pace.tried:
                    break
            try:
                windows = distill.review(self.store, lens, self.model(lens, "review"), self.clock(), self.settings().review_max_chars)
            except ValueError:
                pass  # told by ``complete``
        return {"mined": mined, "windows": windows, "complete": self._complete(lens)}

    def _complete(self, lens: str) -> bool:
        """Whether a lens has read all turns, without a failure, and folded all observations."""
        s = self.store
        totals = queue.session_totals(s.read("raw")).select("session", "n")
        read = s.read("progress").where(F.col("lens") == lens).select("session", "distilled", "retries")
        behind = totals.join(read, "session", "left").where((F.col("n") > F.coalesce("distilled", F.lit(0))) | (F.coalesce("retries", F.lit(0)) > 0))
        cursor = int(s.get(f"review_rowid:{lens}", "0") or 0)
        return behind.isEmpty() and s.read("observations").where((F.col("lens") == lens) & (F.col("seq") > cursor)).isEmpty()

    def preview(self, lens: str) -> DataFrame:
        """What mining would give now; nothing is stored."""
        tail = queue.lens_tail(self.store.read("raw"), self.store.read("progress"), [lens])
        with self._runners(lens):
            model = self.model(lens)
        return models.mine(text.chunks(tail, self.settings().chunk_max_chars), model, lens, self.embed)

    def preview_review(self, lens: str) -> DataFrame:
        """The lens's facets as the next window would leave them; nothing is stored."""
        with self._runners(lens):
            return distill.preview_review(self.store, lens, self.model(lens, "review"), self.clock(), self.settings().review_max_chars)

    def candidates(self, lens: str) -> DataFrame:
        cited = self.store.read("facet_versions").select("lens", "dimension", "key", F.explode("because_of").alias("obs_id"))
        return arcs.candidates(self.store.read("observations"), cited, lens).orderBy(*arcs.salience())

    # -- health ----------------------------------------------------------------
    def status(self) -> dict:
        s = self.store
        facets = s.read("facet_versions").select("lens", "dimension", "key").distinct()
        row = queue.stats(s.read("raw"), s.read("observations"), facets, s.read("progress"), s.read("staged"), self.lenses(), self.clock()).first().asDict()
        row["last_review"] = s.get("review_ts")
        row["raw_through"] = s.read("raw").agg(F.coalesce(F.max("ts"), F.lit(""))).first()[0]
        row["distilled_through"] = queue.last_distilled_ts(s.read("raw"), s.read("progress")).agg(F.coalesce(F.max("last_ts"), F.lit(""))).first()[0]
        return row

    def doctor(self) -> dict:
        s = self.store
        bad = queue.session_totals(s.read("raw")).where(F.col("updated_at").isNull()).count()
        future = queue.next_backoff(s.read("progress"), self.lenses(), self.clock()).first()[0]
        drift = {k: s.get(f"mine_drift_{k}") for k in ("total", "last_ts", "last_session", "last_lens")}
        checks = {"embedder": self._embeds(), "lenses": self._known_lenses()}
        if self.runners is None:
            checks["models"] = all(callable(self.model(x)) for x in self.lenses())
            wrong = []
        else:
            wrong = runners.problems(self.runners, self.settings(), self.definitions())
            checks["models"] = not wrong
        sets = runners.model_sets(self.settings(), self.definitions())
        return self.status() | {"unreadable_sessions": bad, "next_wakeup": future or "", "drift": drift, "model_sets": sets, "problems": wrong, "checks": checks, "ok": all(checks.values())}

    def _embeds(self) -> bool:
        """Whether the embedder gives finite vectors as long as the stored ones."""
        try:
            probe = [float(x) for x in self.embed("probe")]
        except Exception:  # whatever an embedder raises
            return False
        stored = self.store.read("observations").where(F.size("embedding") > 0).select(F.size("embedding")).first()
        return bool(probe) and all(math.isfinite(x) for x in probe) and (stored is None or stored[0] == len(probe))

    def _known_lenses(self) -> bool:
        """Whether each lens that the settings enable is registered, if there is a registry."""
        return self.lens_folder is None or set(self.settings().lenses) <= {DEFAULT_LENS, *(x.name for x in self.registered())}

    def status_json(self) -> str:
        return json.dumps(self.status(), indent=2)
