"""Hook events as a stream, appended to the log batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import capture, in_sequence
from ..store import Append, Store

EVENT = "session_id string, prompt string, last_assistant_message string, effort struct<level:string>, cwd string"


def hook_events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON event files as they come in; lines that aren't JSON have no session."""
    rows = spark.readStream.schema(EVENT).option("mode", "PERMISSIVE").json(folder)
    return rows.withColumn("effort", F.col("effort.level"))


def append_events(events: DataFrame, store: Store, checkpoint: str, now: str) -> StreamingQuery:
    """Append each micro-batch once: its number is kept with the rows' commit, so a
    batch that is replayed after a failure changes nothing. Turns go on from the
    last one of their session, in the order of the batch."""

    def write(batch: DataFrame, number: int) -> None:
        if int(store.get("capture_batch", "-1")) >= number:
            return
        rows = capture(batch, now)
        done = store.spark.createDataFrame([("capture_batch", str(number))], "key string, value string")

        def change(s: Store) -> dict[str, DataFrame]:
            from ..operators.tables import upsert

            return {"raw": Append(s._numbered(in_sequence(rows, s.read("raw")), s.next_id())), "meta": upsert(s.read("meta"), done, "key")}

        store.update(change)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
