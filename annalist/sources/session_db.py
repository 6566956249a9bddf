"""A Python data source for the editors' SQLite session stores (no JDBC driver is
at hand). ``spark.read.format("session_db").option("path", ...).option("table",
"message").load()`` reads one table; session rows changed since ``since`` (ms,
inclusive) and not of the scratch ``agent`` are picked in the database."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The tables of the store.
SCHEMAS = {
    "session": "id string, directory string, title string, time_created long, time_updated long, agent string",
    "message": "id string, session_id string, time_created long, time_updated long, data string",
    "part": "id string, message_id string, session_id string, time_created long, time_updated long, data string",
}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table = options["path"], options.get("table", "session")
        self.since, self.scratch = int(options.get("since", 0)), options.get("scratch", "")
        self.columns = [f.name for f in schema.fields]
        self.pieces = max(1, int(options.get("partitions", 4)))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            top = db.execute(f'select coalesce(max(rowid), 0) from "{self.table}"').fetchone()[0]
        step = -(-top // self.pieces) or 1
        return [_Range(a, min(a + step - 1, top)) for a in range(1, top + 1, step)] or [_Range(1, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            there = {r[1] for r in db.execute(f'pragma table_info("{self.table}")')}
            names = ", ".join(f'"{c}"' if c in there else f'null as "{c}"' for c in self.columns)
            where, values = "rowid between ? and ?", [partition.low, partition.high]
            if self.table == "session":
                where, values = where + " and time_updated >= ?", [*values, self.since]
                if self.scratch and "agent" in there:
                    where, values = where + " and agent is not ?", [*values, self.scratch]
            yield from db.execute(f'select {names} from "{self.table}" where {where}', values)


class SessionDb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_db"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "session")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionDb)
