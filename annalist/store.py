"""The engine's tables on shared storage, changed by atomic snapshots.

Each table lives in Parquet folders that are written once. A manifest names the
folders of every table; a commit writes new folders, then creates the next
manifest, which only one writer can, so that readers see all of a commit or none
of it. A commit replaces a table's folders or adds one (:class:`Append`), so that
what an append writes doesn't follow the table's size; :meth:`Store.compact` and
:meth:`Store.vacuum` tidy up. Several tables change in one commit, and a guard
can refuse it (compare-and-set on the version).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import ingest, queue, tables

# The columns of the stored tables.
SCHEMAS = {
    "raw": "id long, session string, seq int, ts string, role string, effort string, text string",
    "session_meta": "session string, cwd string, started string, platform string",
    "observations": "seq long, obs_id string, ts string, session string, lens string, dimension string, observation string, evidence string, poignancy int, source string, embedding array<float>",
    "staged": "id long, session string, obs_id string, lens string, payload string",
    "facet_versions": "lens string, dimension string, key string, last_seen string, pos int, value string, valid_from string, valid_to string, recorded_at string, because_of array<string>, confidence double",
    "progress": "session string, lens string, distilled int, retries int, distilled_at string, next_attempt string, drift_at string",
    "meta": "key string, value string",
    "profiles": "lens string, markdown string, signature string",
}


#: What older stores hold nothing of, by table: columns that came later.
DEFAULTS = {"raw": {"effort": ""}, "progress": {"retries": 0, "next_attempt": "", "drift_at": ""}, "facet_versions": {"recorded_at": "", "valid_to": ""}}


def _filled(s: Store) -> Changes:
    """Columns that came later get their defaults."""
    there = s.manifest()["tables"]
    return {name: s.read(name).fillna(told) for name, told in DEFAULTS.items() if there.get(name)}


def _clamped(s: Store) -> Changes:
    """Review cursors beyond the last observation go back to it, so that what comes
    next isn't passed over."""
    top = s.next_id("observations", "seq") - 1
    cursor = F.col("key").startswith("review_rowid:") | (F.col("key") == "review_obs_rowid")
    return {"meta": s.read("meta").withColumn("value", F.when(cursor & (F.col("value").cast("long") > top), F.lit(str(top))).otherwise(F.col("value")))}


#: The steps from each format of a store to the next one. Manifests of the first
#: format name one folder a table and no format.
MIGRATIONS: tuple[Callable[[Store], Changes], ...] = (_filled, _clamped)
FORMAT = 1 + len(MIGRATIONS)


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Append:
    """Rows that a commit adds to a table."""

    rows: DataFrame


Changes = Mapping[str, DataFrame | Append]


class Store:
    """Tables under one folder; see the module's text."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    # -- manifest ---------------------------------------------------------
    def manifest(self) -> dict:
        """{"version": n, "format": n, "tables": {name: [folder]}} of the newest commit.
        A manifest that isn't written to its end is none yet."""
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return {"version": 0, "format": FORMAT, "tables": {}}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        versions = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        for v in reversed(versions):
            rows = self.spark.read.text(f"{self.root}/_manifests/{v:012d}.json", wholetext=True).collect()
            try:
                told = json.loads(rows[0]["value"] if rows else "")
            except ValueError:
                continue
            return told | {"format": told.get("format", 1), "tables": {k: [x] if isinstance(x, str) else x for k, x in told["tables"].items()}}
        return {"version": 0, "format": FORMAT, "tables": {}}

    def migrate(self) -> int:
        """Bring a store of an older format to this one, a commit a step; the number
        of steps. A store of a newer format is refused."""
        steps = 0
        while (now := self.manifest())["format"] != FORMAT:
            if now["format"] > FORMAT:
                raise ValueError(f"the store's format {now['format']} is newer than {FORMAT}")
            try:
                self.commit(MIGRATIONS[now["format"] - 1](self), now["version"], now["format"] + 1)
            except Conflict:  # another engine took the step
                continue
            steps += 1
        return steps

    def commit(self, changes: Changes, expected: int | None = None, format: int | None = None) -> int:
        """Write the tables and publish them together; the new version. Fails if
        ``expected`` isn't the version now, or another commit takes the next one."""
        now = self.manifest()
        if expected is not None and now["version"] != expected:
            raise Conflict(f"version is {now['version']}, not {expected}")
        folders = dict(now["tables"])
        for name, change in changes.items():
            schema = T._parse_datatype_string(SCHEMAS[name])
            folder, more = f"{name}/{uuid.uuid4().hex}", isinstance(change, Append)
            df = change.rows if more else change
            df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields)).write.mode("error").parquet(f"{self.root}/{folder}")
            folders[name] = [*folders.get(name, []), folder] if more else [folder]
        version = now["version"] + 1
        self._publish(f"{self.root}/_manifests/{version:012d}.json", json.dumps({"version": version, "format": format or now["format"], "tables": folders}))
        return version

    def _publish(self, target: str, text: str) -> None:
        """Create the file, which fails if another commit has."""
        try:
            out = self._fs.create(self._path(target), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict("another commit came first") from None
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table as it is, or as a manifest has it."""
        folders = (manifest or self.manifest())["tables"].get(name)
        schema = T._parse_datatype_string(SCHEMAS[name])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in folders)) if folders else self.spark.createDataFrame([], schema)

    def compact(self, *names: str) -> int:
        """Rewrite tables of several folders as one each."""
        return self.update(lambda s: {n: s.read(n) for n in names or SCHEMAS if len(s.manifest()["tables"].get(n, [])) > 1})

    def vacuum(self, keep: int = 10) -> int:
        """Delete the folders that none of the newest ``keep`` manifests names, and
        older manifests; the number of folders. Not while a commit is being written."""
        top = self.manifest()["version"]
        used, folder = set(), self._path(f"{self.root}/_manifests")
        for path in [s.getPath() for s in self._fs.listStatus(folder)]:
            version = path.getName()[:-5]
            if not version.isdigit():
                continue
            if int(version) <= top - keep:
                self._fs.delete(path, False)
            elif text := self.spark.read.text(f"{self.root}/_manifests/{path.getName()}", wholetext=True).collect():
                used |= {x for folders in json.loads(text[0]["value"])["tables"].values() for x in ([folders] if isinstance(folders, str) else folders)}
        gone = 0
        for name in SCHEMAS:
            if self._fs.exists(self._path(f"{self.root}/{name}")):
                for s in self._fs.listStatus(self._path(f"{self.root}/{name}")):
                    if f"{name}/{s.getPath().getName()}" not in used:
                        self._fs.delete(s.getPath(), True)
                        gone += 1
        return gone

    def update(self, change: Callable[[Store], Changes], attempts: int = 5) -> int:
        """Compute changes from the tables as they are and commit them; again if
        another commit came between."""
        for left in range(attempts, 0, -1):
            version = self.manifest()["version"]
            try:
                changes = change(self)
                return self.commit(changes, version) if changes else version
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    # -- log --------------------------------------------------------------
    def next_id(self, table: str = "raw", column: str = "id") -> int:
        return (self.read(table).agg(F.max(column)).first()[0] or 0) + 1

    def append_raw(self, rows: DataFrame) -> int:
        """Append (session, ts, role, effort, text, seq); ids go on from the last."""
        return self.update(lambda s: {"raw": Append(s._numbered(rows, s.next_id()))})

    @staticmethod
    def _numbered(rows: DataFrame, first: int) -> DataFrame:
        """Ids in (session, seq) order without one global sort: the high part is
        the task's, the low part the row's."""
        ordered = rows.repartitionByRange("session", "seq").sortWithinPartitions("session", "seq")
        return ordered.withColumn("id", F.monotonically_increasing_id() + first).select("id", "session", "seq", "ts", "role", F.coalesce("effort", F.lit("")).alias("effort"), "text")

    def import_sessions(self, rows: DataFrame, meta: DataFrame, keys: DataFrame, replace: bool) -> int:
        """One commit: drop the sessions' rows and progress if ``replace``, insert the
        rows, upsert session_meta and the stored key lists."""

        def change(s: Store) -> dict[str, DataFrame]:
            raw, progress = s.read("raw"), s.read("progress")
            if replace:
                gone = rows.select("session").distinct()
                raw, progress = raw.join(gone, "session", "left_anti"), progress.join(gone, "session", "left_anti")
            new = s._numbered(rows, s.next_id())
            return {"raw": raw.unionByName(new) if replace else Append(new), **({"progress": progress} if replace else {}), "session_meta": tables.upsert(s.read("session_meta"), meta, "session"), "meta": tables.upsert(s.read("meta"), keys, "key")}

        return self.update(change)

    def record_meta(self, meta: DataFrame) -> int:
        """Insert sessions that aren't known; known ones stay."""
        return self.update(lambda s: {"session_meta": Append(meta.dropDuplicates(["session"]).join(s.read("session_meta"), "session", "left_anti"))})

    def set_platform(self, session: str, platform: str) -> int:
        def change(s: Store) -> dict[str, DataFrame]:
            old = s.read("session_meta")
            new = s.spark.createDataFrame([(session,)], "session string").join(old, "session", "left")
            return {"session_meta": tables.upsert(old, new.select("session", F.coalesce("cwd", F.lit("")).alias("cwd"), F.coalesce("started", F.lit("")).alias("started"), F.lit(platform).alias("platform")), "session")}

        return self.update(change)

    def prune(self, cutoff: str) -> int:
        """Drop the log of sessions that ended before; observations and facets stay."""

        def change(s: Store) -> dict[str, DataFrame]:
            stale = queue.prune_before(s.read("raw"), cutoff).select("session")
            drop = lambda t: s.read(t).join(stale, "session", "left_anti")
            keyed = s.read("meta").withColumn("session", F.regexp_extract("key", r"^(?:file|opencode)_import_keys:(.*)$", 1))
            return {"raw": drop("raw"), "progress": drop("progress"), "session_meta": drop("session_meta"), "meta": keyed.join(stale, "session", "left_anti").drop("session")}

        return self.update(change)

    # -- observations -----------------------------------------------------
    def add_observations(self, new: DataFrame) -> int:
        def change(s: Store) -> dict[str, DataFrame]:
            old = s.read("observations")
            first = s.next_id("observations", "seq")
            fresh = tables.insert_or_ignore(old, new.withColumn("seq", F.monotonically_increasing_id()))
            return {"observations": Append(fresh.withColumn("seq", F.monotonically_increasing_id() + first))}

        return self.update(change)

    def stage(self, new: DataFrame, per_session: int = 200, total: int = 5000) -> int:
        return self.update(lambda s: {"staged": Append(tables.stage_capped(s.read("staged"), new, per_session, total))})

    def clear_staged(self, session: str, through: int) -> int:
        return self.update(lambda s: {"staged": s.read("staged").where((F.col("session") != session) | (F.col("id") > through))})

    def delete_observation(self, obs_id: str) -> bool:
        """Drop one observation and its lens's fold cursor, in one commit."""
        found = self.read("observations").where(F.col("obs_id") == obs_id).select("lens").first()
        if not found:
            return False
        self.update(lambda s: {"observations": s.read("observations").where(F.col("obs_id") != obs_id), "meta": s.read("meta").where(F.col("key") != f"review_rowid:{found['lens']}")})
        return True

    def commit_distillation(self, mined: DataFrame, marks: DataFrame, now: str) -> int:
        """Observations, watermarks and the count of drifted marks together. A mark
        whose generation is gone is refused with all that was mined of its session,
        at the time of the commit itself. The number of marks set."""
        done = 0

        def change(s: Store) -> Changes:
            nonlocal done
            raw, old = s.read("raw"), s.read("observations")
            won = queue.commit_watermarks(s.spark.createDataFrame([], SCHEMAS["progress"]), raw, marks, now)
            drift = won.agg(F.count("*").alias("marks"), F.count(F.when(F.col("drift_at") != "", 1)).alias("n"), F.max(F.when(F.col("drift_at") != "", F.struct("session", "lens"))).alias("last")).first()
            done = drift["marks"]
            if not done:
                return {}
            own = mined.join(won.select("session", "lens"), ["session", "lens"], "left_semi")
            fresh = tables.insert_or_ignore(old, own.withColumn("seq", F.monotonically_increasing_id())).withColumn("seq", F.monotonically_increasing_id() + s.next_id("observations", "seq"))
            changes: dict[str, DataFrame | Append] = {"observations": Append(fresh), "progress": queue.commit_watermarks(s.read("progress"), raw, marks, now)}
            if drift["n"]:
                changes["meta"] = s._drift_counted(drift["n"], *drift["last"], now)
            return changes

        self.update(change)
        return done

    def reset_lens(self, lens: str) -> int:
        return self.update(lambda s: {"progress": s.read("progress").where(F.col("lens") != lens), "meta": s.read("meta").where(F.col("key") != f"review_rowid:{lens}")})

    def delete_lens(self, lens: str) -> int:
        return self.update(lambda s: {"observations": tables.delete_lens(s.read("observations"), lens), "progress": tables.delete_lens(s.read("progress"), lens), "facet_versions": tables.delete_lens(s.read("facet_versions"), lens), "meta": tables.delete_lens_meta(s.read("meta"), lens)})

    # -- meta and profiles --------------------------------------------------
    def get(self, key: str, default: str = "") -> str:
        row = self.read("meta").where(F.col("key") == key).select("value").first()
        return row["value"] if row else default

    def set(self, values: Mapping[str, str]) -> int:
        new = self.spark.createDataFrame(list(values.items()), SCHEMAS["meta"])
        return self.update(lambda s: {"meta": tables.upsert(s.read("meta"), new, "key")})

    def increment(self, key: str, by: int = 1) -> int:
        """Add to a counter in one commit; its new value."""
        now = 0

        def change(s: Store) -> Changes:
            nonlocal now
            now = int(s.get(key, "0") or 0) + by
            return {"meta": tables.upsert(s.read("meta"), s.spark.createDataFrame([(key, str(now))], SCHEMAS["meta"]), "key")}

        self.update(change)
        return now

    def _drift_counted(self, n: int, session: str, lens: str, now: str) -> DataFrame:
        """The meta table with ``n`` more drifts, the last of them that of ``session``."""
        total = int(self.get("mine_drift_total", "0") or 0) + n
        told = {"mine_drift_total": str(total), "mine_drift_last_ts": now, "mine_drift_last_session": session, "mine_drift_last_lens": lens}
        return tables.upsert(self.read("meta"), self.spark.createDataFrame(list(told.items()), SCHEMAS["meta"]), "key")

    def write_profile(self, lens: str, markdown: str, signature: str) -> int:
        new = self.spark.createDataFrame([(lens, markdown, signature)], SCHEMAS["profiles"])
        return self.update(lambda s: {"profiles": tables.upsert(s.read("profiles"), new, "lens")})

    def delete_profile(self, lens: str) -> int:
        return self.update(lambda s: {"profiles": s.read("profiles").where(F.col("lens") != lens)})

    def export(self, target: str, force: bool = False) -> None:
        """All tables as one commit left them, a folder each, under one folder."""
        where, manifest = self._path(target), self.manifest()
        if self._fs.exists(where) and not force:
            raise FileExistsError(target)
        for name in SCHEMAS:
            self.read(name, manifest).write.mode("overwrite").parquet(f"{target}/{name}")

    # -- merges -------------------------------------------------------------
    def ingest_lines(self, lines: DataFrame, now: str) -> dict[str, int]:
        """Merge NDJSON lines (value, line_no) into the log; counts by action. Sessions
        with updates are rewritten and read anew by every lens; others only grow."""
        parsed = ingest.parse_records(lines)
        told = ingest.group_records(parsed.where("ok").drop("ok"), "line_no", now).withColumnRenamed("line_no", "ord")
        raw = self.read("raw")
        keys = self.read("meta").where(F.col("key").startswith("file_import_keys:"))
        stored = keys.select(F.expr("substring(key, 18)").alias("session"), F.posexplode(F.from_json("value", "array<string>")).alias("pos", "record_key"))
        rid = F.regexp_extract("record_key", r"(?s)^(.+):[^:]*$", 1)
        nth = raw.select("session", "id", "text", "ts", "role").withColumn("pos", F.expr("row_number() over (partition by session order by id) - 1"))
        stored = stored.join(nth, ["session", "pos"]).select("session", "pos", "record_key", F.when(rid == "h", "").otherwise(rid).alias("record_id"), "text", "ts", "role")
        acts = ingest.merge_actions(stored.select("session", "record_id", "record_key"), told).cache()
        counts = {r["action"]: r["count"] for r in acts.groupBy("action").count().collect()}
        counts["bad_lines"] = parsed.where("not ok").count()
        work = acts.where("action <> 'skip'").select("session").distinct()
        if counts.get("append") or counts.get("update"):
            merged = ingest.merged_rows(stored.select("session", "record_id", "record_key", "text", "pos"), acts).join(work, "session", "left_semi")
            extra = stored.select("session", "record_key", "ts", "role").unionByName(told.select("session", "record_key", "ts", "role")).dropDuplicates(["session", "record_key"])
            rows = merged.join(extra, ["session", "record_key"], "left").select("session", F.col("pos").cast("int").alias("seq"), F.coalesce("ts", F.lit(now)).alias("ts"), F.coalesce("role", F.lit("document")).alias("role"), F.lit("").alias("effort"), "text", "record_key")
            lists = rows.groupBy("session").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", "record_key"))), lambda x: x["record_key"])).alias("value"))
            edited = acts.where("action = 'update'").select("session").distinct()

            def change(s: Store) -> dict[str, DataFrame]:
                kept = s.read("raw").join(work, "session", "left_anti")
                return {
                    "raw": kept.unionByName(s._numbered(rows, s.next_id())), "progress": s.read("progress").join(edited, "session", "left_anti"),
                    "session_meta": tables.upsert(s.read("session_meta"), work.select("session", F.lit("").alias("cwd"), F.lit(now).alias("started"), F.lit("file").alias("platform")), "session"),
                    "meta": tables.upsert(s.read("meta"), lists.select(F.concat(F.lit("file_import_keys:"), "session").alias("key"), "value"), "key"),
                }

            self.update(change)
        acts.unpersist()
        return counts
