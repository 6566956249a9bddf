import json
import sqlite3

import pytest

from annalist.engine import Engine
from annalist.operators.models import hash_embedder

NOW = "2024-05-01T00:00:00Z"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/archive", lens_folder=tmp_path / "lenses", clock=lambda: NOW)


def test_from_log_to_recall(engine, tmp_path):
    path = tmp_path / "in.ndjson"
    path.write_text("\n".join(json.dumps({"text": f"user: note {k}", "id": str(k), "session": "s", "ts": "2024-04-01"}) for k in range(3)))
    assert engine.ingest(str(path))["append"] == 3
    assert engine.ingest(str(path)) == {"skip": 3, "bad_lines": 0}
    assert engine.record("s", " likes tea ", poignancy=40) == "staged"
    assert engine.record("s", "likes tea") == "duplicate"
    with pytest.raises(ValueError):
        engine.record("s", "x" * 3000)
    assert engine.run()["staged"] == 1
    top = engine.search("likes tea", k=2).collect()
    assert top[0]["observation"] == "likes tea" and abs(top[0]["score"] - 1) < 1e-6 and top[0]["poignancy"] == 10
    assert "likes tea" in engine.render_search("likes tea")
    with pytest.raises(ValueError):
        engine.search("  ")
    status = engine.status()
    assert (status["sessions"], status["raw_records"], status["pending"]) == (1, 3, 0)
    assert engine.doctor()["ok"]
    assert engine.cleanup(90) == {"sessions": 0, "rows": 0} and engine.cleanup(10, confirm=True)["sessions"] == 1
    assert engine.status()["raw_records"] == 0
    engine.export(f"file://{tmp_path}/out")
    with pytest.raises(FileExistsError):
        engine.export(f"file://{tmp_path}/out")


def test_lenses_and_settings(engine, tmp_path):
    folder = tmp_path / "walks"
    folder.mkdir()
    (folder / "lens.json").write_text('{"name": "walks", "dimensions": ["pace"]}')
    (folder / "extract.md").write_text("find walks")
    assert engine.register(folder).dimensions == ("pace",)
    with pytest.raises(ValueError):
        engine.register(folder)
    assert engine.lenses() == ("default",)
    engine.enable("walks")
    engine.set_setting("review_every", "9")
    assert engine.lenses() == ("walks",) and engine.settings().review_every == 9
    engine.disable("walks")
    assert engine.lenses() == ("default",)
    engine.deregister("walks")
    assert engine.registered() == []


def test_import_grows_and_rebuilds(engine, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.executescript(
            """create table session(id text primary key, directory text, title text, time_created int, time_updated int);
            create table message(id text primary key, session_id text, time_created int, time_updated int, data text);
            create table part(id text primary key, message_id text, session_id text, time_created int, time_updated int, data text);
            insert into session values ('s1','/x','t',1,10);
            insert into message values ('m1','s1',1,1,'{"role":"user"}');
            insert into part values ('p1','m1','s1',1000,1,'{"type":"text","text":"hello"}');"""
        )
    assert engine.import_database(path) == {"replace": 1}
    assert engine.import_database(path) == {"unchanged": 1}
    with sqlite3.connect(path) as db:
        db.executescript("""insert into message values ('m2','s1',2,2,'{"role":"user"}'); insert into part values ('p2','m2','s1',2000,2,'{"type":"text","text":"more"}');""")
    assert engine.import_database(path) == {"append": 1}
    with sqlite3.connect(path) as db:
        db.execute("""update part set data = '{"type":"text","text":"hello!"}' where id = 'p1'""")
    assert engine.import_database(path) == {"replace": 1}
    assert [r["text"] for r in engine.store.read("raw").orderBy("id").collect()] == ["hello!", "more"]


def test_hash_embedder_is_a_unit_vector():
    v = hash_embedder("x")
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == hash_embedder("x")


def _refuse():
    raise ConnectionError("no answer")


def test_runners_open_close_and_break(spark, tmp_path):
    from annalist.operators.models import echo_miner
    from annalist.operators.runners import LocalRunner, RunnerDown

    lenses = tmp_path / "lenses"
    for name, spec in (("a", {}), ("b", {"runner": "gone"}), ("c", {"extract_model": "none"})):
        (lenses / name).mkdir(parents=True)
        (lenses / name / "lens.json").write_text(json.dumps({"name": name, **spec}))
    main = LocalRunner({"": echo_miner}, concurrent=False)
    e = Engine(spark, f"file://{tmp_path}/archive", lens_folder=lenses, clock=lambda: NOW, runners={"": main, "gone": LocalRunner({"": echo_miner}, on_open=_refuse)})
    for name in "abc":
        e.enable(name)
    e.store.append_raw(spark.createDataFrame([("s", 0, NOW, "user", "", "I walk")], "session string, seq int, ts string, role string, effort string, text string"))
    assert e.run()["mined"] == 1 and not main.is_open
    assert {(r["lens"], r["distilled"], r["retries"]) for r in e.store.read("progress").collect()} == {("a", 1, 0), ("b", 0, 1), ("c", 0, 1)}
    assert e.doctor()["problems"] == ["runner '': no model 'none'"] and e.doctor()["model_sets"] == {"": ["none"]}
    with e._runners():
        assert e.pace().window == 1
    e.runners = {"": LocalRunner({}, on_open=_refuse)}
    with pytest.raises(RunnerDown):
        e.run()


def test_starved_calls_narrow_the_window(spark, tmp_path):
    from annalist.plans import distill

    def late(text):
        raise TimeoutError

    e = Engine(spark, f"file://{tmp_path}/archive", clock=lambda: NOW)
    e.store.append_raw(spark.createDataFrame([(f"s{k}", 0, NOW, "user", "", "t") for k in range(4)], "session string, seq int, ts string, role string, effort string, text string"))
    pace = distill.Pace(4)
    assert distill.drain(e.store, ["default"], lambda lens: late, NOW, pace=pace) == 0
    assert (pace.window, pace.tried) == (2, 4)
    assert distill.drain(e.store, ["default"], lambda lens: late, "2024-06-01T00:00:00Z", pace=pace) == 0 and pace.tried == 0


def test_a_run_waits_for_backoffs(spark, tmp_path):
    from annalist.operators.models import echo_miner

    now, slept = [NOW], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] = "2024-05-01T00:05:00Z"
        e.models = {"": echo_miner}

    e = Engine(spark, f"file://{tmp_path}/archive", {"": lambda text: "[{"}, clock=lambda: now[0])
    e.store.append_raw(spark.createDataFrame([("s", 0, NOW, "user", "", "t")], "session string, seq int, ts string, role string, effort string, text string"))
    assert e.run(wait_backoffs=True, sleep=sleep)["mined"] == 1 and slept == [300.0]
    assert e.kick() is None


def test_scopes_of_settings(engine, tmp_path):
    folder = tmp_path / "walks"
    folder.mkdir()
    (folder / "lens.json").write_text('{"name": "walks"}')
    engine.register(folder)
    engine.config_set("runner", "main")
    engine.config_set("triage_model", "small")
    engine.config_set("mine_model", "own", "walks")
    assert [engine.config_get("mine_model", x) for x in ("", "walks")] == ["small", "own"]
    assert engine.config_list("walks") == {"runner": "main", "mine_model": "own", "review_model": ""}
    engine.config_unset("extract_model", "walks")
    assert engine.config_get("mine_model", "walks") == "small"
    assert engine.config_path("walks").endswith("lens.json")
    with pytest.raises(ValueError):
        engine.config_set("review_every", "3", "walks")
    with pytest.raises(ValueError):
        engine.config_set("runner", "x", "none")


def test_seed_show_update_and_try(engine, tmp_path, spark):
    assert engine.seed() == "done" and engine.settings().lenses == ("default",)
    engine.disable("default")
    engine.deregister("default")
    assert engine.seed() == "done" and engine.registered() == []
    folder = tmp_path / "unified"
    folder.mkdir()
    (folder / "extract.md").write_text("find")
    engine.store.append_raw(spark.createDataFrame([("s", 0, NOW, "user", "", "I walk")], "session string, seq int, ts string, role string, effort string, text string"))
    assert {r["lens"] for r in engine.try_lens(str(folder)).collect()} == {"candidate"} and engine.store.read("observations").isEmpty()
    (folder / "lens.json").write_text('{"name": "walks", "dimensions": ["pace"]}')
    engine.register(folder)
    (folder / "lens.json").write_text('{"name": "walks", "dimensions": ["speed"]}')
    engine.update_lens(folder)
    assert engine.show("walks")["dimensions"] == ["speed"] and not engine.show("walks")["enabled"]
    with pytest.raises(ValueError):
        engine.show("none")


def test_doctor_sees_a_broken_embedder(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/archive", clock=lambda: NOW, embed=lambda text: [float("nan")])
    assert not e.doctor()["ok"] and not e.doctor()["checks"]["embedder"]


def test_a_newer_store_is_refused(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/archive", clock=lambda: NOW)
    e.store.commit({}, format=99)
    with pytest.raises(ValueError):
        Engine(spark, f"file://{tmp_path}/archive")


def test_commands(spark, tmp_path, capsys):
    from annalist.__main__ import main

    root = f"file://{tmp_path}/archive"
    assert main([root, "config", "set", "runner", "main"]) == 0 and main([root, "config", "get", "runner"]) == 0
    assert capsys.readouterr().out.split() == ["null", '"main"']
    assert main([root, "backfill", "walks", "--fresh"]) == 0 and main([root, "doctor"]) == 0
