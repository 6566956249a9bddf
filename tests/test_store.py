import json
import sqlite3
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from annalist.operators import ingest, models, queue
from annalist.operators.history import apply_assertions, version_islands
from annalist.operators.vectors import decode_floats, encode_floats, persistent_groups
from annalist.plans import distill
from annalist.store import SCHEMAS, Conflict, Store
from annalist.streaming.capture import EVENT, append_events, hook_events

NOW = "2024-05-01T00:00:00Z"


def lines(spark, *records):
    return spark.createDataFrame([(k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)], "line_no long, value string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_ingest_is_idempotent_and_edits_in_place(spark, store):
    first = lines(spark, {"text": "a", "id": "1", "session": "s"}, "not json", "", {"id": "2"}, {"text": "b", "id": "2", "session": "s"}, {"text": "free"}, {"text": "free"})
    assert store.ingest_lines(first, NOW) == {"append": 3, "skip": 1, "bad_lines": 2}
    assert store.ingest_lines(first, NOW) == {"skip": 4, "bad_lines": 2}
    store.commit({"progress": spark.createDataFrame([("file:s", "default", 2, 0, "", "", "")], SCHEMAS["progress"])})
    assert store.ingest_lines(lines(spark, {"text": "c", "id": "3", "session": "s"}), NOW)["append"] == 1
    assert store.read("progress").count() == 1  # growth keeps watermarks
    assert store.ingest_lines(lines(spark, {"text": "b2", "id": "2", "session": "s"}), NOW)["update"] == 1
    assert store.read("progress").count() == 0  # an edit makes lenses read anew
    got = [r["text"] for r in store.read("raw").where("session = 'file:s'").orderBy("id").collect()]
    assert got == ["a", "b2", "c"]


def test_commits_are_atomic_and_guarded(spark, store):
    store.set({"a": "1"})
    version = store.manifest()["version"]
    store.set({"b": "2"})
    with pytest.raises(Conflict):
        store.commit({}, version)
    assert (store.get("a"), store.get("b"), store.get("c", "x")) == ("1", "2", "x")


def test_capture_stream_appends_each_batch_once(spark, store, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    events = [{"session_id": "s", "prompt": "hi", "last_assistant_message": "x"}, {"session_id": "s", "last_assistant_message": "yes", "effort": {"level": "high"}}, {"session_id": "", "prompt": "lost"}, {"session_id": "s"}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, events)))
    for _ in range(2):
        append_events(hook_events(spark, str(folder)), store, f"{tmp_path}/cp", NOW).awaitTermination()
    rows = {(r["role"], r["text"], r["effort"]) for r in store.read("raw").collect()}
    assert rows == {("user", "hi", ""), ("assistant", "yes", "high")} and store.read("raw").count() == 2
    assert sorted(r["seq"] for r in store.read("raw").collect()) == [0, 1]
    assert "effort" in EVENT


def test_distilling(spark, store):
    rows = spark.createDataFrame([("s1", 0, "2024-01-01T00:00:00Z", "user", "", "I walk"), ("s1", 1, "2024-01-02T00:00:00Z", "assistant", "", "good"), ("s2", 0, "", "user", "", "cut off")], "session string, seq int, ts string, role string, effort string, text string")
    store.append_raw(rows)
    assert store.read("raw").select("id").distinct().count() == 3
    model = lambda lens: lambda text: "[{\"a\": " if "cut" in text else models.echo_miner(text)
    assert distill.drain(store, ["default"], model, NOW) == 1
    assert {r["observation"] for r in store.read("observations").collect()} == {"I walk", "good"}
    retry = store.read("progress").where("session = 's2'").first()
    assert (retry["retries"], retry["next_attempt"]) == (1, "2024-05-01T00:05:00Z")
    assert distill.drain(store, ["default"], model, NOW) == 0
    fold = lambda text: json.dumps([{"dimension": "habits", "key": "walk", "value": "daily", "confidence": 1.7, "because_of": ["o"], "contradicts_prior": True}])
    assert distill.review(store, "default", fold, NOW) == 1
    assert distill.review(store, "default", fold, NOW) == 0
    got = store.read("facet_versions").collect()
    assert [(r["value"], r["valid_to"], r["confidence"]) for r in got] == [("daily", "", 1.0)]
    assert distill.summarise(store, lambda page: page.upper()) == ["default"]
    assert distill.summarise(store, lambda page: page.upper()) == []
    obs = store.read("observations").first()["obs_id"]
    assert store.delete_observation(obs) and not store.delete_observation("none")
    assert store.get("review_rowid:default") == ""
    store.prune("2024-02-01")
    assert store.read("raw").count() == 0 and store.read("observations").count() == 1
    store.delete_lens("default")
    assert store.read("facet_versions").count() == 0


def test_every_drifted_session_is_stamped_and_counted(spark, store):
    turns = "session string, seq int, ts string, role string, effort string, text string"
    store.append_raw(spark.createDataFrame([(f"s{k}", 0, "2024-01-01T00:00:00Z", "user", "", "fine" if k == 0 else "odd") for k in range(4)], turns))
    model = lambda lens: lambda text: models.echo_miner(text) if "fine" in text else "I can't."
    assert distill.drain(store, ["default"], model, NOW) == 4
    assert {r["session"]: r["drift_at"] for r in store.read("progress").collect()} == {"s0": "", "s1": NOW, "s2": NOW, "s3": NOW}
    assert (store.get("mine_drift_total"), store.get("mine_drift_last_session"), store.get("mine_drift_last_lens")) == ("3", "s3", "default")
    store.append_raw(spark.createDataFrame([("s1", 1, "2024-01-02T00:00:00Z", "user", "", "fine")], turns))
    assert distill.drain(store, ["default"], lambda lens: models.echo_miner, NOW) == 1
    assert {r["session"] for r in store.read("progress").where("drift_at <> ''").collect()} == {"s2", "s3"}
    assert store.get("mine_drift_total") == "3"


def test_a_gone_generation_refuses_the_commit(spark, store):
    marks = spark.createDataFrame([("s", "default", 1, 77)], "session string, lens string, distilled int, raw_high_id long")
    assert not store.commit_distillation(store.read("observations").drop("seq"), marks, NOW)


def test_what_is_mined_goes_with_its_mark(spark, store):
    turns = "session string, seq int, ts string, role string, effort string, text string"
    store.append_raw(spark.createDataFrame([(x, 0, NOW, "user", "", "t") for x in ("a", "b")], turns))
    high = {r["session"]: r["id"] for r in store.read("raw").collect()}
    marks = spark.createDataFrame([("a", "default", 1, high["a"]), ("b", "default", 1, high["b"])], "session string, lens string, distilled int, raw_high_id long")
    mined = spark.createDataFrame([(f"o{x}", NOW, x, "default", "d", "o", "", 1, "mined", None) for x in "ab"], "obs_id string, ts string, session string, lens string, dimension string, observation string, evidence string, poignancy int, source string, embedding array<float>")
    store.commit({"raw": store.read("raw").where("session = 'a'")})
    assert store.commit_distillation(mined, marks, NOW) == 1
    assert [r["obs_id"] for r in store.read("observations").collect()] == ["oa"]
    assert [r["session"] for r in store.read("progress").collect()] == ["a"]


def test_appends_add_folders(spark, store):
    turns = "session string, seq int, ts string, role string, effort string, text string"
    size = lambda folder: sum(p.stat().st_size for p in (Path(store.root.removeprefix("file://")) / folder).glob("*.parquet"))
    store.append_raw(spark.createDataFrame([("a", k, NOW, "user", "", f"{k} text " * 50) for k in range(3000)], turns))
    for k in range(2):
        store.append_raw(spark.createDataFrame([("b", k, NOW, "user", "", "t")], turns))
    first, *rest = store.manifest()["tables"]["raw"]
    assert len(rest) == 2 and all(size(x) < size(first) / 5 for x in rest)
    before = sorted(map(tuple, store.read("raw").collect()))
    store.compact()
    assert len(store.manifest()["tables"]["raw"]) == 1 and sorted(map(tuple, store.read("raw").collect())) == before
    assert store.vacuum(keep=1) == 3 and store.read("raw").count() == 3002


def test_a_failing_profile_leaves_the_others(spark, store):
    facets = [(lens, "d", "k", NOW, 0, "v", NOW, "", NOW, [], 0.5) for lens in ("a", "b")]
    store.commit({"facet_versions": spark.createDataFrame(facets, SCHEMAS["facet_versions"])})

    def model(page):
        if page.startswith("LENS: a") and "LENS: b" not in page:
            raise RuntimeError("down")
        return page[:7]

    assert distill.summarise(store, model) == ["b"]
    assert {r["lens"] for r in store.read("profiles").collect()} == {"b", "unified"} and store.get("profile_error:a") == "down"


def test_the_judge_reads_every_member(spark, store, monkeypatch):
    n, told = 230, []
    ids = [f"o{k:03}" for k in range(n)]
    rows = [(k, i, "2024-01-01", f"s{k % 3}", "l", "d", f"note {k}", "", 1, "mined", [1.0, 0.0]) for k, i in enumerate(ids)]
    store.commit({"observations": spark.createDataFrame(rows[::-1], SCHEMAS["observations"])})
    arc = lambda signature: (signature, n, 0.0, "", ids)
    found = spark.createDataFrame([arc("good"), arc("bad")], "signature string, n long, coverage double, facet string, ids array<string>")
    monkeypatch.setattr(distill.arcs, "candidates", lambda *a: found)
    monkeypatch.setattr(distill.arcs, "to_verify", lambda arcs, seen, budget: arcs)
    malformed, facet = {"dimension": "d", "key": " "}, {"dimension": "d", "key": "k", "value": "v", "confidence": 0.5}

    def judge(text):
        told.append([r["obs_id"] for r in json.loads(text)["observations"]])
        return json.dumps([malformed, facet] if len(told) == 1 else [malformed])

    assert distill.emerge(store, "l", judge, NOW) == 2
    assert told == [ids, ids]
    outcomes = [json.loads(r["value"])["outcome"] for r in store.read("meta").collect()]
    assert sorted(outcomes) == ["accepted", "rejected"]
    got = store.read("facet_versions").collect()
    assert [(r["key"], r["value"], sorted(r["because_of"])) for r in got] == [("k", "v", ids)]


def asserts(spark, *rows):
    return spark.createDataFrame([("l", "d", "k", v, c, o, n, x) for n, (v, c, o, x) in enumerate(rows)], "lens string, dimension string, key string, value string, confidence double, obs_id string, ord long, contradicts boolean")


def test_fold_reinforces_supersedes_and_reopens(spark):
    got = version_islands(asserts(spark, ("a", 0.5, "o1", False), ("b", 0.9, "o2", False), ("b", 0.2, "o3", True), ("b", 0.4, "o4", True), (" ", 1.0, "o5", True))).orderBy("pos").collect()
    assert [(r["value"], r["confidence"], r["because_of"], r["until"]) for r in got] == [("a", 0.9, ["o1", "o2"], 2), ("b", 0.4, ["o3", "o4"], None)]
    cols = "lens string, dimension string, key string, last_seen string, pos int, value string, valid_from string, valid_to string, recorded_at string, because_of array<string>, confidence double"
    old = spark.createDataFrame([("l", "d", "k", "t1", 0, "x", "t0", "t1", "t0", ["p"], 0.3), ("l", "d", "k", "t1", 1, "a", "t1", "", "t1", ["q"], 0.6), ("l", "d", "other", "t1", 0, "z", "t0", "", "t0", [], 0.1)], cols)
    new = apply_assertions(old, asserts(spark, ("a", 0.8, "q", False), ("c", 0.4, "r", True)), NOW).orderBy("key", "pos").collect()
    assert [(r["key"], r["pos"], r["value"], r["valid_from"], r["valid_to"], r["because_of"], r["confidence"]) for r in new] == [
        ("k", 0, "x", "t0", "t1", ["p"], 0.3), ("k", 1, "a", "t1", NOW, ["q"], 0.8), ("k", 2, "c", NOW, "", ["r"], 0.4), ("other", 0, "z", "t0", "", [], 0.1),
    ]
    closed = old.where("pos = 0 and key = 'k'")
    again = apply_assertions(closed, asserts(spark, ("y", 0.5, "s", False)), NOW).orderBy("pos").collect()
    assert [(r["pos"], r["value"], r["valid_to"]) for r in again] == [(0, "x", "t1"), (1, "y", "")]


def test_persistence_is_one_graph(spark):
    rows = [(k, [1.0, 0.004 * k, 0.0]) for k in range(6)] + [(10 + k, [0.0, 1.0, 0.004 * k]) for k in range(6)]
    got = persistent_groups(spark.createDataFrame(rows, "seq long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {0, 10} and len(got) == 12


def test_vector_codec(spark):
    df = spark.createDataFrame([(1, encode_floats([0.5, -2.0])), (2, None), (3, b"xyz")], "id long, embedding binary")
    got = {r["id"]: r["embedding"] for r in df.mapInPandas(decode_floats(), "id long, embedding array<float>").collect()}
    assert got == {1: [0.5, -2.0], 2: None, 3: None}


def test_session_database(spark, tmp_path):
    from annalist.sources.session_db import register

    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.executescript(
            """create table session(id text primary key, directory text, title text, time_created int, time_updated int, agent text);
            create table message(id text primary key, session_id text, time_created int, time_updated int, data text);
            create table part(id text primary key, message_id text, session_id text, time_created int, time_updated int, data text);
            insert into session values ('s1','/x','t',1,10,null), ('s2','/x','t',1,20,'scratch'), ('s3','/x','t',1,5,'b');
            insert into message values ('m1','s1',1,1,'{"role":"user"}'), ('m2','s1',2,2,'{"role":"assistant","time":{"completed":5}}'), ('m3','s1',3,3,'{"role":"assistant","time":{}}');
            insert into part values ('p1','m1','s1',1000,1,'{"type":"text","text":"hello"}'), ('p2','m2','s1',2000,2,'{"type":"text","text":"first note"}'),
              ('p3','m2','s1',2001,2,'{"type":"tool","text":"no"}'), ('p4','m2','s1',2002,2,'{"type":"text","text":"final answer"}'), ('p5','m3','s1',3000,3,'{"type":"text","text":"late"}');"""
        )
    register(spark)
    read = lambda t: spark.read.format("session_db").option("path", path).option("table", t).option("since", 10).option("scratch", "scratch").load()
    assert [r["id"] for r in read("session").collect()] == ["s1"]
    turns = ingest.read_turns(read("message"), read("part")).orderBy("time_created").collect()
    assert [(r["role"], r["text"], r["ts"]) for r in turns] == [("user", "hello", "1970-01-01T00:00:01Z"), ("assistant", "first note\n\nfinal answer", "1970-01-01T00:00:02Z")]


def test_pending_range_and_empty_lenses(spark):
    raw = spark.createDataFrame([(1, "old", 0, "2026-07-01T00:00:00Z", "user", "", "x"), (2, "in", 0, "2026-07-09 10:00:00", "user", "", "y"), (3, "odd", 0, "07/26/2026", "user", "", "z")], SCHEMAS["raw"])
    none = spark.createDataFrame([], SCHEMAS["staged"])
    progress = spark.createDataFrame([], SCHEMAS["progress"])
    pick = lambda *a: sorted(r["session"] for r in queue.pending_sessions(raw, none, progress, *a).collect())
    assert pick(["default"], NOW) == ["in", "odd", "old"]
    assert pick(["default"], NOW, "2026-07-08", "2026-07-11T23:59:59Z") == ["in"]
    assert pick([], NOW) == []
    assert queue.session_totals(raw).where(F.col("updated_at").isNull()).count() == 1


def _noted(spark, texts):
    rows = [(k + 1, f"o{k}", "2024-01-01", "s", "l", "d", t, "", 1, "mined", [1.0]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows[::-1], SCHEMAS["observations"])


def test_windows_are_read_in_tasks_whole_and_in_order(spark, store):
    import os

    texts = [f'note "{k}" \u00e9\n' * (k % 7 + 1) for k in range(40)]
    store.commit({"observations": _noted(spark, texts)})
    rows = [r.asDict() for r in store.read("observations").drop("embedding").orderBy("seq").collect()]
    want, left = [[]], 3000
    for r in rows:
        n = len(distill.pretty(r).encode())
        if want[-1] and n > left:
            want.append([])
            left = 3000
        want[-1].append(r)
        left -= n
    here = os.getpid()

    def fold(text):  # tells what it read, and whether it runs in the driver
        page, _, rows = text.partition("\n[")
        return json.dumps([{"dimension": "d", "key": str(json.loads("[" + rows)[0]["seq"]), "value": f"{os.getpid() == here} {page.count('- d/')} {'[' + rows}", "confidence": 0.5, "because_of": ["o"]}])

    assert distill.review(store, "l", fold, NOW, 3000) == len(want) > 3
    got = {r["key"]: r["value"] for r in store.read("facet_versions").where("valid_to = ''").collect()}
    assert got == {str(w[0]["seq"]): f"False {k} {distill.pretty(w)}" for k, w in enumerate(want)}
    assert store.get("review_rowid:l") == "40" and distill.review(store, "l", fold, NOW, 3000) == 0


def test_replies_that_cannot_be_folded_raise(spark, store):
    store.commit({"observations": _noted(spark, ["a"])})

    def down(text):
        raise RuntimeError("down")

    odd = [lambda text: json.dumps([{"dimension": "d", "key": "k", "value": "v", "confidence": "high"}]), lambda text: json.dumps([{"dimension": "d", "key": "k", "value": chr(0xD800)}]), lambda text: "none", down]
    for model in odd:
        with pytest.raises(ValueError, match="of lens l"):
            distill.review(store, "l", model, NOW)
    assert store.get("review_rowid:l") == "" and store.read("facet_versions").count() == 0
