"""``python -m annalist ROOT COMMAND ...``: the engine's commands."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from .engine import Engine
from .sources import settings


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="annalist")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("status", "doctor", "summarise", "stop", "kick", "compact", "vacuum", "load-default"):
        sub.add_parser(name)
    for name, *args in (("ingest", "path"), ("import", "path"), ("export", "path"), ("search", "query"), ("facets", "lens"), ("profile", "lens"), ("candidates", "lens"), ("register", "path"), ("deregister", "lens"), ("update", "path"), ("show", "lens"), ("try", "path"), ("delete", "obs_id"), ("enable", "lens"), ("disable", "lens"), ("preview-review", "lens"), ("record", "session", "observation")):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
    work = sub.add_parser("run")
    work.add_argument("--since", default="")
    work.add_argument("--until", default="")
    work.add_argument("--wait-backoffs", action="store_true")
    sub.add_parser("review").add_argument("--full", action="store_true")
    again = sub.add_parser("backfill")
    again.add_argument("lens")
    again.add_argument("--fresh", action="store_true")
    config = sub.add_parser("config")
    config.add_argument("verb", choices=("get", "set", "unset", "list", "path"))
    config.add_argument("key", nargs="?", default="")
    config.add_argument("value", nargs="?", default="")
    config.add_argument("--lens", default="")
    p.add_argument("--lenses", default=None, help="folder of registered lenses")
    clean = sub.add_parser("cleanup")
    clean.add_argument("--days", type=int, default=90)
    clean.add_argument("--yes", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.root, lens_folder=a.lenses, environment={k: os.environ.get(f"ANNALIST_{k.upper()}", "") for k in settings.SCOPED})
    rows = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]
    configure = {
        "get": lambda: e.config_get(a.key, a.lens), "set": lambda: e.config_set(a.key, a.value, a.lens), "unset": lambda: e.config_unset(a.key, a.lens),
        "list": lambda: e.config_list(a.lens), "path": lambda: e.config_path(a.lens),
    }
    out = {
        "status": lambda: e.status(), "doctor": lambda: e.doctor(), "run": lambda: e.run(a.since, a.until, a.wait_backoffs), "review": lambda: e.review(a.full), "summarise": lambda: e.summarise(), "stop": lambda: e.stop(),
        "kick": lambda: e.kick(), "compact": lambda: e.store.compact(), "vacuum": lambda: e.store.vacuum(), "load-default": lambda: e.load_default(),
        "ingest": lambda: e.ingest(a.path), "import": lambda: e.import_database(a.path), "export": lambda: e.export(a.path), "search": lambda: rows(e.search(a.query)),
        "facets": lambda: rows(e.facets(a.lens)), "profile": lambda: e.profile(a.lens), "candidates": lambda: rows(e.candidates(a.lens)), "backfill": lambda: e.backfill(a.lens, a.fresh),
        "register": lambda: e.register(a.path).name, "deregister": lambda: e.deregister(a.lens), "update": lambda: e.update_lens(a.path).name, "show": lambda: e.show(a.lens), "try": lambda: rows(e.try_lens(a.path)),
        "preview-review": lambda: rows(e.preview_review(a.lens)), "config": lambda: configure[a.verb](),
        "delete": lambda: e.delete(a.obs_id), "enable": lambda: e.enable(a.lens), "disable": lambda: e.disable(a.lens),
        "record": lambda: e.record(a.session, a.observation), "cleanup": lambda: e.cleanup(a.days, a.yes),
    }[a.command]()
    print(json.dumps(out, indent=2, default=str))
    broken = (a.command == "doctor" and not out["ok"]) or (a.command == "backfill" and not out["complete"])
    return int(broken)


if __name__ == "__main__":
    raise SystemExit(main())
