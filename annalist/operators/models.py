"""The opaque functions of the engine, models and embedders, and what runs them."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import parse_array
from ..functions.scalars import obs_id

#: A model: the text it reads to the text it replies.
Model = Callable[[str], str]


def echo_miner(text: str) -> str:
    """A deterministic stand-in: one observation for each turn it reads."""
    turns = [x for x in text.split("\n\n") if ": " in x]
    return json.dumps([{"dimension": t.split(": ", 1)[0].lower(), "observation": t.split(": ", 1)[1], "evidence": "", "poignancy": 1 + len(t) % 9} for t in turns])


def hash_embedder(text: str, dim: int = 32) -> list[float]:
    """A deterministic unit vector for a text."""
    out: list[float] = []
    for k in range(-(-dim // 8)):
        block = hashlib.blake2b(text.encode(), digest_size=64, salt=k.to_bytes(8, "little")).digest()
        out += [int.from_bytes(block[i : i + 8], "little") / 2**63 - 1 for i in range(0, 64, 8)]
    norm = math.sqrt(sum(x * x for x in out[:dim])) or 1.0
    return [x / norm for x in out[:dim]]


def sanitised(column: str):
    """For mapInPandas: NFC, which has no built-in form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[column] = b[column].map(lambda x: x if x is None else unicodedata.normalize("NFC", x.encode("utf-8", "replace").decode("utf-8", "replace")))
            yield b

    return run


def mine(chunks: DataFrame, model: Model, lens: str, embed: Callable[[str], list[float]] = hash_embedder) -> DataFrame:
    """Observations of all chunks (session, chunk, text): the model is called once
    for each chunk, in the tasks; replies that are truncated or hold no array give
    a row of that status and no observation. A session with a truncated chunk is
    withheld whole, and one is drifted only if no chunk gave anything."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for session, chunk, text in zip(b["session"], b["chunk"], b["text"], strict=True):
                try:
                    status, items = parse_array(model(text))
                except TimeoutError:  # asked, and not served in time
                    status, items = "starved", []
                except Exception:  # a failing model call is a failed chunk
                    status, items = "failed", []
                items = [x for x in items if str(x.get("observation") or "").strip()]
                for k, x in enumerate(items):
                    told = str(x["observation"]).strip()
                    rows.append((session, chunk, status, k, str(x.get("dimension") or ""), told, str(x.get("evidence") or ""), max(1, _int(x.get("poignancy"))), embed(told)))
                if not items:
                    rows.append((session, chunk, status, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["session", "chunk", "status", "n", "dimension", "observation", "evidence", "poignancy", "embedding"]).astype({"n": "Int64", "poignancy": "Int64"})

    out = chunks.select("session", "chunk", "text").mapInPandas(run, "session string, chunk int, status string, n long, dimension string, observation string, evidence string, poignancy long, embedding array<double>")
    return out.withColumn("lens", F.lit(lens)).withColumn("obs_id", F.when(F.col("observation").isNotNull(), obs_id(F.col("session"), F.col("lens"), F.col("observation"))))


def session_outcomes(mined: DataFrame) -> DataFrame:
    """session, failed, drifted, starved out of :func:`mine`'s rows."""
    bad = F.col("status").isin("truncated", "failed", "starved")
    out = mined.groupBy("session").agg(F.max(bad.cast("int")).alias("bad"), F.max((F.col("status") == "starved").cast("int")).alias("late"), F.count("observation").alias("n"), F.max((F.col("status") == "none").cast("int")).alias("none"))
    return out.select("session", (F.col("bad") == 1).alias("failed"), ((F.col("bad") == 0) & (F.col("n") == 0) & (F.col("none") == 1)).alias("drifted"), (F.col("late") == 1).alias("starved"))


def _int(x: object) -> int:
    try:
        return int(x)
    except (TypeError, ValueError):
        return 0
