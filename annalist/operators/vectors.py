"""Recall and graph clustering over vector columns."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, dot, k_band
from ..scratch import materialise
from .graph import components

BLOCK_ROWS = 2048


def embedded(obs: DataFrame, lens: str = "") -> DataFrame:
    """Observations of a lens (all if empty) that have a vector."""
    rows = obs.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    return rows.where(F.col("lens") == lens) if lens else rows


def search(obs: DataFrame, query: Column, lens: str = "", k: int = 8) -> DataFrame:
    """Filter, then rank by cosine; equal scores go to the smaller seq; k <= 0 is all."""
    scored = embedded(obs, lens).withColumn("score", cosine(F.col("embedding"), query)).orderBy(F.desc("score"), "seq")
    return scored.limit(k) if k > 0 else scored


def nearest(rows: DataFrame, k: int, node: str = "seq", vector: str = "embedding") -> DataFrame:
    """i, j, rank, score: the k nearest of each row by cosine, ties to the smaller j.

    Exact, in blocks: rows are dealt into blocks, each pair of blocks is one
    matrix product, and only each row's k best leave a pair of blocks."""
    n = rows.count()
    blocks = max(1, ceil(n / BLOCK_ROWS))
    dealt = rows.select(F.col(node).cast("long").alias("node"), F.col(vector).cast("array<double>").alias("v")).withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select("node", "v", F.col("block").alias("a"), others.alias("b"), F.lit(True).alias("asks"))
    right = dealt.select("node", "v", others.alias("a"), F.col("block").alias("b"), F.lit(False).alias("asks"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        out: list[tuple] = []
        dims = pdf["v"].map(len)
        for dim in dims.unique():
            own = (dims == dim).to_numpy()
            p, q = pdf[own & asks], pdf[own & ~asks]
            if not len(p) or not len(q):
                continue
            x, y = (np.stack(z["v"].to_numpy()) for z in (p, q))
            nx, ny = (np.sqrt((z * z).sum(1)) for z in (x, y))
            norms = np.outer(nx, ny)
            s = np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0)
            i, j = p["node"].to_numpy(), q["node"].to_numpy()
            s[i[:, None] == j[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(j, s.shape), -s), axis=1)[:, :k]
            r = np.repeat(np.arange(len(i)), order.shape[1])
            c = order.ravel()
            keep = np.isfinite(s[r, c])
            out.append((i[r][keep], j[c][keep], s[r, c][keep]))
        if not out:
            return pd.DataFrame({"i": [], "j": [], "score": []}).astype({"i": "int64", "j": "int64", "score": "float64"})
        return pd.DataFrame({"i": np.concatenate([o[0] for o in out]), "j": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    found = left.unionByName(right).groupBy("a", "b").applyInPandas(best, "i long, j long, score double")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mutual_edges(near: DataFrame, k: int) -> DataFrame:
    """i < j where each is among the other's k nearest."""
    close = near.where(F.col("rank") <= k).select("i", "j")
    back = close.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return close.where("i < j").join(back, ["i", "j"], "left_semi")


def persistent_groups(rows: DataFrame, n_all: int | None = None, node: str = "seq", vector: str = "embedding") -> DataFrame:
    """node, component: rows that fall together for at least half of the
    neighbour counts of the band, joined into components of two or more.

    The mutual edges of one k are among those of every larger one, so components
    only grow with k: two rows are together for at least half of the band exactly
    if they are together for the k of which half the band is that large or larger.
    That one graph's components are the answer, without any pairs."""
    n = rows.count()
    band = k_band(n if n_all is None else n_all)
    k = max(1, min(band[-((len(band) + 1) // 2)], n - 1))
    edges = mutual_edges(nearest(rows, k, node, vector), k)
    return components(edges.select(F.col("i").alias("u"), F.col("j").alias("v")))


def centroids(members: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, centroid: the normalised mean vector of each group; vectors of
    another length than the group's first (smallest seq) are left out, and a
    mean of length 0 stays zero."""
    sized = members.withColumn("_n", F.size(vector))
    lengths = sized.groupBy(group).agg(F.min_by("_n", "seq").alias("_n"))
    flat = sized.join(lengths, [group, "_n"]).select(group, F.posexplode(F.col(vector)).alias("at", "x"))
    means = flat.groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("_norm", norm).select(group, F.when(F.col("_norm") > 0, F.transform("mean", lambda x: x / F.col("_norm"))).otherwise(F.col("mean")).alias("centroid"))


def reexpand(members: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """group, seq: every observation whose inner product with a group's centroid
    reaches the least one among the group's members. Centroids, one row for each
    candidate arc, meet the observations block by block."""
    centre = centroids(members, group)
    radius = members.join(centre, group).groupBy(group).agg(F.min(dot(F.col("embedding"), F.col("centroid"))).alias("radius"))
    arcs = materialise(centre.join(radius, group), "arcs")
    n = max(1, ceil(arcs.count() / BLOCK_ROWS))
    # Keys of one type on both sides: a cogroup of int and long keys meets nowhere.
    told = arcs.withColumn("part", F.pmod(F.xxhash64(group), F.lit(n)).cast("int"))
    lots = obs.where(F.size("embedding") > 0).select(F.col("seq").cast("long").alias("seq"), F.col("embedding").cast("array<double>").alias("v"))
    m = max(1, ceil(lots.count() / BLOCK_ROWS))
    lots = lots.withColumn("lot", F.pmod(F.xxhash64("seq"), F.lit(m)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    told = told.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("part", "lot", F.col(group).cast("long").alias("g"), "centroid", "radius")

    def within(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int]] = []
        dims_a, dims_b = a["centroid"].map(len), b["v"].map(len)
        for dim in dims_a.unique():
            p, q = a[dims_a == dim], b[dims_b == dim]
            if len(q):
                x, y = np.stack(p["centroid"].to_numpy()), np.stack(q["v"].to_numpy())
                r, c = np.nonzero(x @ y.T >= p["radius"].to_numpy()[:, None] - 1e-12)
                rows += zip(p["g"].to_numpy()[r].tolist(), q["seq"].to_numpy()[c].tolist(), strict=True)
        return pd.DataFrame(rows, columns=["g", "seq"]).astype("int64")

    found = told.groupBy("part", "lot").cogroup(lots.groupBy("part", "lot")).applyInPandas(within, "g long, seq long")
    own = members.select(F.col(group).cast("long").alias("g"), F.col("seq").cast("long").alias("seq"))
    return found.unionByName(own).distinct().withColumnRenamed("g", group)


def decode_floats(blob: str = "embedding"):
    """A function for mapInPandas that turns little-endian float32 bytes into arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[blob] = b[blob].map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist())
            yield b

    return run


def encode_floats(vector: list[float] | None) -> bytes | None:
    return np.asarray(vector, "<f4").tobytes() if vector is not None and len(vector) else None
