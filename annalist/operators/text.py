"""Transcripts, chunks and rendered pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rendered

OVERLAP = 2


def transcripts(rows: DataFrame, key: str = "session", order: str = "id") -> DataFrame:
    """One transcript per session. A session is what one model call reads."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), rendered(F.col("role"), F.col("text")).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("transcript"))


def chunk_bounds(sizes: list[int], budget: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Greedy chunks [start, end) over record sizes; each next chunk goes back over
    the last records of the one before, if that is longer than the overlap."""
    if budget <= 0:
        return [(0, len(sizes))] if sizes else []
    out, start = [], 0
    while start < len(sizes):
        end, used = start + 1, sizes[start]
        while end < len(sizes) and used + sizes[end] <= budget:
            used += sizes[end]
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = end - overlap if end - start > overlap else end
    return out


def chunks(rows: DataFrame, budget: int, key: str = "session", order: str = "id") -> DataFrame:
    """key, chunk, first, last, n, text: overlapping chunks of each session. Sizes
    count the characters of role and text and four more for each record."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        bounds = chunk_bounds(pdf["size"].tolist(), budget)
        o, t = pdf["o"].tolist(), pdf["t"].tolist()
        return pd.DataFrame({"key": pdf["key"].iloc[0], "chunk": range(len(bounds)), "first": [o[a] for a, _ in bounds], "last": [o[b - 1] for _, b in bounds], "n": [b - a for a, b in bounds], "text": ["".join(t[a:b]) for a, b in bounds]})

    told = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("o"), (F.length("role") + F.length("text") + 4).alias("size"), rendered(F.col("role"), F.col("text")).alias("t"))
    return told.groupBy("key").applyInPandas(cut, "key string, chunk int, first long, last long, n int, text string").withColumnRenamed("key", key)


def hit_line(ts: Column, dimension: Column, observation: Column, evidence: Column, obs_id: Column) -> Column:
    more = F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(F.lit("  evidence: "), evidence, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("- ["), ts, F.lit(" · "), dimension, F.lit("] "), observation, F.lit("\n"), more, F.lit("  id: "), obs_id, F.lit("\n"))


def facet_line(dimension: Column, key: Column, confidence: Column, value: Column) -> Column:
    return F.format_string("- %s/%s (%.2f): %s\n", dimension, key, confidence, value)


def summary_input(current: DataFrame) -> DataFrame:
    """lens, text: the current facets of each lens as one page, in (dimension, key)
    order."""
    line = facet_line(F.col("dimension"), F.col("key"), F.col("confidence"), F.col("value"))
    lines = F.array_sort(F.collect_list(F.struct("dimension", "key", line.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "")
    return current.groupBy("lens").agg(body.alias("body")).select("lens", F.concat(F.lit("LENS: "), F.col("lens"), F.lit("\n\nFACETS (dimension/key, confidence, value):\n"), F.col("body")).alias("text"))


def arc_note(n: Column, sessions: Column, days: Column, first: Column, last: Column, coverage: Column, facet: Column) -> Column:
    """The head of what a judge of a candidate arc reads."""
    note = F.when((facet != "") & (coverage > 0), F.format_string(" Of these, %.0f%% are cited by the facet %s already.", coverage * 100, facet)).otherwise("")
    return F.concat(F.format_string("CANDIDATE ARC: %d observations, %d sessions, %d days (%s..%s).", n, sessions, days, F.substring(first, 1, 10), F.substring(last, 1, 10)), note)
