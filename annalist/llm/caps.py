"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation
a vector is cut in two halves, each with a code of its own, and a direction is
a pair of code words; ``CODES`` such codes make the shared filters of a pair
nearly independent. List decoding sorts the inner products of both halves and
walks down the pairs whose sum exceeds the cap height, so that every vector gets
all its filters and no other pair is looked at. The height follows from the
number of vectors, so that a cap holds about ``CAP_ROWS`` unrelated ones; the
number of directions follows from the height, so that a pair at the threshold
shares ``SHARED`` filters in the mean, and is missed with a probability of about
exp(-SHARED).

Vectors are joined on filters and verified in double precision, block by block:
a cap with many rows is dealt out in pairs of blocks, a pair of vectors counts in
the least filter it shares alone, and what leaves a block are link counts and
star edges, never pairs. Equal vectors are one node with a multiplicity.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link; repeated
rows count as vectors of their own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erfc, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialise
from .vectors import by_key, keyed, matrix, usable

CODES, CAP_ROWS, SHARED, BLOCK_ROWS = 128, 48, 12.0, 1024
MAX_WORDS = 8192


def _tail(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def _both(z: float, rho: float) -> float:
    """P(X > z and Y > z) of standard normals with correlation rho."""
    x = np.linspace(z, z + 9, 4000)
    density = np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    beyond = np.array([_tail((z - rho * t) / sqrt(1 - rho * rho)) for t in x])
    return float(np.sum(density * beyond) * (x[1] - x[0]))


def parameters(n: int, threshold: float) -> tuple[float, int]:
    """(cap height in standard deviations, code words in each half)."""
    z = NormalDist().inv_cdf(1 - min(0.01, CAP_ROWS / max(1, n)))
    while (words := ceil(sqrt(SHARED / _both(z, threshold) / CODES))) > MAX_WORDS:
        z -= 0.05
    return z, words


@lru_cache(maxsize=64)
def _code(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rotation and the code words of both halves. The inner product of a direction
    with any unit vector is standard normal."""
    rng = np.random.default_rng((seed, dim, words))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cut = (dim + 1) // 2
    return turn, rng.standard_normal((cut, words)), rng.standard_normal((max(1, dim - cut), words)), cut


def filters(unit: np.ndarray, z: float, words: int) -> list[np.ndarray]:
    """The sorted filters of each unit vector: in every code all pairs (i, j) of
    code words whose inner products sum to more than z."""
    found: list[list[np.ndarray]] = [[] for _ in unit]
    for code in range(CODES):
        turn, first, second, cut = _code(unit.shape[1], words, code)
        turned = unit @ turn
        one = turned[:, :cut] @ first
        two = turned[:, cut:] @ second if cut < unit.shape[1] else np.zeros((len(unit), words))
        order = np.argsort(-two, axis=1)
        falling = np.take_along_axis(two, order, 1)
        row, head = np.nonzero(one > z - falling[:, :1])
        for r, i, need in zip(row.tolist(), head.tolist(), (z - one[row, head]).tolist(), strict=True):
            n = int(np.searchsorted(-falling[r], -need, side="left"))
            found[r].append((code * words + i) * words + order[r, :n])
    return [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]


def _least_shared(rows: list[np.ndarray], cols: list[np.ndarray], hits: np.ndarray) -> np.ndarray:
    """``hits`` without the pairs that share an earlier filter, given those of each."""
    names = np.unique(np.concatenate([*rows, *cols, np.zeros(0, np.int64)]))
    if not len(names):
        return hits

    def marks(lists: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(lists), len(names)), np.float32)
        m[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.searchsorted(names, np.concatenate(lists))] = 1
        return m

    return hits & (marks(rows) @ marks(cols).T < 0.5)


def _local_labels(hits: np.ndarray) -> np.ndarray:
    """The least place that each place of a symmetric link matrix reaches."""
    label = np.arange(len(hits))
    while True:
        least = np.minimum(label, np.where(hits, label, len(label)).min(1, initial=len(label)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _verify(threshold: float):
    names = ["u", "links", "v"]

    def handle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        if t.num_rows < 2:
            return
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        many, unit = t.column("many").to_numpy(), matrix(t.column("vec")).astype(float)
        unit /= np.sqrt((unit * unit).sum(1))[:, None]
        # In a pair of blocks, rows of side 1 meet those of side 2; side 0 is a block with itself.
        at, to = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(ids)),) * 2
        hits = unit[at] @ unit[to].T >= threshold
        if not side.any():
            np.fill_diagonal(hits, False)
        r, c = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
        if not len(r):
            return
        hits, at, to = hits[np.ix_(r, c)], at[r], to[c]
        lists = t.column("earlier").combine_chunks()
        own = [lists[k].values.to_numpy() for k in at.tolist()]
        other = own if not side.any() else [lists[k].values.to_numpy() for k in to.tolist()]
        counted = _least_shared(own, other, hits)
        nodes = at if not side.any() else np.concatenate([at, to])
        if side.any():
            links = np.concatenate([counted @ many[to], counted.T @ many[at]])
            square = np.zeros((len(nodes), len(nodes)), bool)
            square[: len(at), len(at) :] = hits
            square[len(at) :, : len(at)] = hits.T
        else:
            links, square = counted @ many[to], hits
        order = np.argsort(ids[nodes], kind="stable")
        label = np.empty(len(nodes), np.int64)
        label[order] = order[_local_labels(square[np.ix_(order, order)])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[nodes]), pa.array(links.astype(np.int64)), pa.array(ids[nodes[label]])], names=names)

    return by_key(["filter", "pair"], handle)


def link(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    rows = keyed(vectors)
    nodes = rows.groupBy("a", "b").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.any_value("vec").alias("vec"))
    nodes = materialise(nodes, "vectors")
    z, words = parameters(nodes.count(), threshold)
    # Components travel in the type that they came in; all sums are in double precision.
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, arrow_kind = ("array<float>", pa.float32()) if single else ("array<double>", pa.float64())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sizes = np.array([len(x) for x in b.column("vec")])
                for dim in np.unique(sizes).tolist():
                    some = b.take(pa.array(np.flatnonzero(sizes == dim)))
                    v = matrix(some.column("vec"))
                    unit = v / np.sqrt((v * v).sum(1))[:, None]
                    found = filters(unit, z, words)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id"), some.column("many"), some.column("vec").cast(pa.list_(arrow_kind)), pa.array([x + (dim << 34) for x in found], pa.list_(pa.int64()))],
                        names=["id", "many", "vec", "filters"],
                    )

    decoded = materialise(nodes.select("id", "many", "vec").mapInArrow(decode, f"id long, many long, vec {kind}, filters array<long>"), "decoded")
    # Only crowded caps are dealt out in blocks; they are few, so that the wide rows
    # needn't be shuffled to learn of them.
    crowded = decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count().where(F.col("count") > BLOCK_ROWS)
    crowded = crowded.select("filter", F.ceil(F.col("count") / BLOCK_ROWS).cast("long").alias("blocks"))
    met = decoded.select("id", "many", "vec", "filters", F.explode("filters").alias("filter")).join(crowded, "filter", "left")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # Block x meets itself in the pair (x, x) and each block y in (min, max).
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(
        "filter", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("pair"), "id", "many", "vec",
        F.filter("filters", lambda x: x < F.col("filter")).alias("earlier"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    ).repartition("filter", "pair").sortWithinPartitions("filter", "pair")
    found = materialise(met.mapInArrow(_verify(threshold), "u long, links long, v long"), "found")
    counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    reached = components(found.where("u <> v"))
    classes = nodes.select("a", "b", "id", "many").join(counts, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("a", "b", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    linked = rows.select("vec_id", "a", "b").join(classes, ["a", "b"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    unusable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    unusable = unusable.where(~usable(F.col("vec"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(unusable).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """with recursive x as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0),
e as (select a.vec_id as u, b.vec_id as w from x a join x b on a.vec_id <> b.vec_id
  where case when len(a.v) = len(b.v) then list_cosine_similarity(a.v, b.v) >= 0.95 else false end),
r as (select vec_id, vec_id as o from embeddings union select r.vec_id, e.w from r join e on e.u = r.o),
n as (select u as vec_id, count(*) as c from e group by u)
select vec_id, coalesce(any_value(n.c), 0) as n_links, min(o) as component_id, vec_id = min(o) as kept from r left join n using (vec_id) group by vec_id"""
