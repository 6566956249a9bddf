"""Bi-temporal folds: assertions in order become dated versions of a facet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clamp01, merged_ids

KEY = ("lens", "dimension", "key")


def well_formed(dimension: Column, key: Column, value: Column) -> Column:
    """An assertion counts if none of the three is blank; confidence isn't looked at."""
    return (F.trim(dimension) != "") & (F.trim(key) != "") & (F.trim(value) != "")


def fold_assertions(asserts: DataFrame) -> DataFrame:
    """All assertions with the number of the version that each belongs to.

    Columns: lens, dimension, key, value, confidence, obs_id, ord and
    contradicts. The first assertion of a facet opens a version. A later one
    supersedes it only if it contradicts and differs; otherwise it reinforces the
    open version, even with another value. The value that is current before a row
    is that of the last contradicting row (or the first), so one ordered window
    says where versions start, and no group is ever gathered."""
    ordered = Window.partitionBy(*KEY).orderBy("ord")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = asserts.where(well_formed(F.col("dimension"), F.col("key"), F.col("value"))).withColumn("nth", F.row_number().over(ordered))
    decides = F.when((F.col("nth") == 1) | F.col("contradicts"), F.col("value"))
    rows = rows.withColumn("current", F.last(decides, ignorenulls=True).over(before))
    starts = (F.col("nth") == 1) | (F.col("contradicts") & (F.col("value") != F.col("current")))
    rows = rows.withColumn("starts", starts)
    return rows.withColumn("pos", (F.sum(F.col("starts").cast("int")).over(ordered) - 1).cast("int")).drop("nth", "current")


def version_islands(asserts: DataFrame) -> DataFrame:
    """One row per version: lens, dimension, key, pos, value, confidence, since,
    until (null while open), because_of in order, last_seen."""
    if "contradicts" not in asserts.columns:
        asserts = asserts.withColumn("contradicts", F.lit(True))
    rows = fold_assertions(asserts)
    versions = rows.groupBy(*KEY, "pos").agg(
        F.max(F.when(F.col("starts"), F.col("value"))).alias("value"),
        F.max(clamp01(F.col("confidence"))).alias("confidence"),
        F.min("ord").alias("since"),
        F.max("ord").alias("last_seen"),
        F.array_sort(F.collect_list(F.struct("ord", "obs_id"))).alias("cited"),
    )
    chain = Window.partitionBy(*KEY).orderBy("pos")
    ids = F.array_distinct(F.filter(F.transform("cited", lambda x: x["obs_id"]), lambda x: x != ""))
    return versions.select(*KEY, "pos", "value", "confidence", "since", F.lead("since").over(chain).alias("until"), ids.alias("because_of"), "last_seen")


def apply_assertions(facets: DataFrame, asserts: DataFrame, now: str) -> DataFrame:
    """Fold new assertions into stored facet versions.

    ``facets``: lens, dimension, key, last_seen, pos, value, valid_from, valid_to,
    recorded_at, because_of, confidence. The open version of a facet (the last
    one) enters the fold as its first assertion; closed history passes through,
    and so do facets of which nothing is asserted. A facet without an open version
    is reopened."""
    latest = Window.partitionBy(*KEY).orderBy(F.desc("pos"))
    marked = facets.withColumn("nth", F.row_number().over(latest)).withColumn("n", F.max("pos").over(Window.partitionBy(*KEY)))
    is_open = (F.col("nth") == 1) & (F.col("valid_to") == "")
    touched = asserts.where(well_formed(F.col("dimension"), F.col("key"), F.col("value"))).select(*KEY).distinct()
    opened = marked.where(is_open).join(touched, [*KEY], "left_semi")
    old = opened.select(*KEY, "value", "confidence", F.lit("").alias("obs_id"), F.lit(-1).cast("long").alias("ord"), F.lit(True).alias("contradicts"))
    new = asserts.select(*KEY, "value", "confidence", "obs_id", F.col("ord").cast("long").alias("ord"), F.coalesce("contradicts", F.lit(False)).alias("contradicts"))
    folded = version_islands(old.unionByName(new))
    prior = marked.where(F.col("nth") == 1).select(*KEY, F.col("n"), is_open.alias("was_open"), F.col("valid_from").alias("opened"), F.col("recorded_at").alias("noted"), F.col("because_of").alias("cited"))
    joined = folded.join(prior, [*KEY], "left")
    carried = (F.col("pos") == 0) & F.coalesce("was_open", F.lit(False))
    versions = joined.select(
        *KEY, F.lit(now).alias("last_seen"),
        (F.col("pos") + F.when(F.col("was_open"), F.col("n")).otherwise(F.coalesce(F.col("n") + 1, F.lit(0)))).cast("int").alias("pos"),
        "value",
        F.when(carried, F.col("opened")).otherwise(F.lit(now)).alias("valid_from"),
        F.when(F.col("until").isNull(), "").otherwise(F.lit(now)).alias("valid_to"),
        F.when(carried, F.col("noted")).otherwise(F.lit(now)).alias("recorded_at"),
        F.when(carried, merged_ids(F.col("cited"), F.col("because_of"))).otherwise(F.col("because_of")).alias("because_of"),
        "confidence",
    )
    kept = marked.join(touched.withColumn("seen", F.lit(True)), [*KEY], "left").where(~is_open | F.col("seen").isNull())
    kept = kept.withColumn("last_seen", F.when(F.col("seen"), F.lit(now)).otherwise(F.col("last_seen")))
    return kept.select(*versions.columns).unionByName(versions)


def nested_facets(versions: DataFrame) -> DataFrame:
    """One row per facet, its versions in order."""
    fields = [c for c in versions.columns if c not in KEY]
    return versions.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in fields if c != "pos")))).alias("versions"))


def size_windows(rows: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """Greedy windows over ordered rows: a row that would overflow the budget
    starts the next one; each holds one row at least. Adds ``window``. The sum
    resets, which no frame can say: sorted rows stream by with a running sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, window = object(), 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(key).to_pylist(), b.column("_size").to_pylist(), strict=True):
                if k != now:
                    now, total, window = k, 0, 0
                if total > 0 and total + n > budget:
                    total, window = 0, window + 1
                total += n
                out.append(window)
            names = [c for c in b.schema.names if c != "_size"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int32())], names=[*names, "window"])

    told = rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))).repartition(key).sortWithinPartitions(key, order)
    return told.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("window", T.IntegerType())]))
