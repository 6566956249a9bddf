"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree splits at the median of the projection on the difference of two sample
vectors. Trees are fitted on a bounded sample (``SAMPLE_ROWS``) and deep enough
for leaves of a ``LEAVES``-th of the table, within ``LEAF_ROWS``; every vector of
the table is put into its leaf of every tree. A query pops leaves of all trees
from one priority queue, by the sum of the squared margins that its path gave
up, until the popped leaves hold ``SEARCH_SHARE`` of as many rows as the table
has, repeats over trees included. Leaves and queries meet in slots of bounded
size, where the candidates are ranked exactly, in double precision; each slot
passes on only the best of each query.

On vectors without structure a true neighbour is hardly nearer than others, so
recall follows the share of rows looked at; the default gives 0.9 and more there
(see README) and can be lowered for data with structure.

Defined cases: an empty table, or one without queries, gives no rows; vectors that are null, empty, zero or hold null or non-finite
components take no part; equal distances go to the smaller vec_id; of equal
vectors, the k + 1 smallest ids are kept as candidates, which no result can need
more of; fewer candidates than k give all of them; vectors of another length
than most are compared with none; repeated rows are candidates of their own;
other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import by_key, keyed, matrix

TREES, LEAVES, LEAF_ROWS, SAMPLE_ROWS, SEARCH_SHARE, SLOT_ROWS = 16, 128, (16, 1024), 65_536, 0.9, 8192


class Forest:
    """Trees in arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 3) -> None:
        self.depth, self.trees = depth, trees
        inner = 2**depth - 1
        self.normals = np.zeros((trees, inner, sample.shape[1]), np.float32)
        self.cuts = np.zeros((trees, inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            rows = [np.arange(len(sample))]
            for node in range(inner):
                own = rows[node]
                a, b = sample[rng.choice(own, 2)] if len(own) > 1 else rng.standard_normal((2, sample.shape[1]))
                w = a - b if np.any(a != b) else rng.standard_normal(len(a))
                w = (w / np.sqrt(w @ w)).astype(np.float32)
                seen = sample[own] @ w
                self.normals[t, node], self.cuts[t, node] = w, np.median(seen) if len(own) else 0.0
                rows += [own[seen <= self.cuts[t, node]], own[seen > self.cuts[t, node]]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t][node], dtype=float) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = t * 2**self.depth + node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, rows_in: np.ndarray, budget: float) -> list[int]:
        """Leaves for one query, by one queue over all trees."""
        margins = self.normals.reshape(-1, len(q)) @ q.astype(float)
        margins = margins.reshape(self.trees, -1) - self.cuts
        inner = 2**self.depth - 1
        queue = [(0.0, t, 0) for t in range(self.trees)]
        found, held = [], 0
        while queue and held < budget:
            lost, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                near = 2 * node + 1 + int(m > 0)
                far = 4 * node + 3 - near
                heapq.heappush(queue, (lost + float(m) ** 2, t, far))
                node = near
            leaf = t * 2**self.depth + node - inner
            found.append(leaf)
            held += int(rows_in[leaf])
        return found


def _rank_in_slot(k: int):
    names = ["qa", "qb", "ids", "distance"]

    def handle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        query = t.column("query").to_numpy()
        at, to = np.flatnonzero(query), np.flatnonzero(~query)
        if not len(at) or not len(to):
            return
        vec = matrix(t.column("vec")).astype(float)
        x, ids = vec[to], t.column("ids").combine_chunks().take(pa.array(to))
        first = np.array([i[0].as_py() for i in ids])
        norms = (x * x).sum(1)
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        for block in range(0, len(at), 256):
            some = at[block : block + 256]
            q = vec[some]
            rough = norms - 2 * (q @ x.T)
            n = min(k, len(to))
            edge = np.partition(rough, n - 1, axis=1)[:, n - 1] + 1e-9 * (1 + norms.max() + (q * q).sum(1))
            rows, cols = np.nonzero(rough <= edge[:, None])
            d = x[cols] - q[rows]
            exact = np.sqrt((d * d).sum(1))
            order = np.lexsort((first[cols], exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols, exact = rows[nth < n], cols[nth < n], exact[nth < n]
            yield pa.RecordBatch.from_arrays([pa.array(a[some[rows]]), pa.array(b[some[rows]]), ids.take(pa.array(cols)), pa.array(exact)], names=names)

    return by_key(["slot"], handle)


def search(vectors: DataFrame, is_query: Column, k: int = 10, share: float = SEARCH_SHARE, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows of
    (vec_id, embedding) that ``is_query``, against all other rows."""
    # Components travel in the type that they came in; distances are in double precision.
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = keyed(vectors).withColumn("vec", F.col("vec").cast(kind))
    sizes = {r["n"]: r["count"] for r in rows.groupBy(F.size("vec").alias("n")).count().collect()}
    dim = max(sizes, key=lambda n: (sizes[n], -n), default=1)
    rows = materialise(rows.where(F.size("vec") == dim), "vectors")
    nearest_ids = Window.partitionBy("a", "b").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(nearest_ids)).where(F.col("nth") <= k + 1)
    nodes = few.groupBy("a", "b").agg(F.any_value("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = materialise(nodes, "nodes")
    total = nodes.count()
    leaf = min(max(total / LEAVES, LEAF_ROWS[0]), LEAF_ROWS[1])
    depth = max(1, min(ceil(log2(max(1, total / leaf))), int(log2(SAMPLE_ROWS / 8))))
    part = int(1_000_000 * min(1.0, SAMPLE_ROWS / max(1, total)))
    sample = nodes.where(F.pmod(F.col("a"), F.lit(1_000_000)) < part).select("vec")
    fitted = matrix(sample.toArrow().column("vec"))
    forest = Forest(fitted if len(fitted) else np.zeros((1, dim)), trees, depth)
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.leaves(matrix(b.column("vec")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(found), pa.list_(pa.int64()))], names=[*b.schema.names, "leaves"])

    placed = materialise(nodes.select("a", "b", "vec", "ids").mapInArrow(place, f"a long, b long, vec {kind}, ids array<long>, leaves array<long>"), "placed")
    rows_in = np.zeros(forest.trees * 2**depth, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        rows_in[r["leaf"]] = r["count"]
    # A slot is a part of a leaf; a query goes to all parts.
    parts = np.maximum(1, -(-rows_in // SLOT_ROWS))
    told = rows.sparkSession.sparkContext.broadcast((rows_in, parts, max(share * total, 20.0 * k)))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_in, parts, budget = told.value
        for b in batches:
            slots = [[leaf << 20 | p for leaf in shared.value.search(q, rows_in, budget) for p in range(parts[leaf])] for q in matrix(b.column("vec"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots, pa.list_(pa.int64()))], names=[*b.schema.names, "slots"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, _ = told.value
        for b in batches:
            leaves = np.array(b.column("leaves").to_pylist(), np.int64).reshape(b.num_rows, -1)
            slots = leaves << 20 | (b.column("b").to_numpy() % (1 << 40))[:, None] % parts[leaves]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(slots), pa.list_(pa.int64()))], names=[*b.schema.names[:4], "slots"])

    asked = rows.where(is_query).select("vec_id", "a", "b")
    query_keys = asked.select("a", "b").distinct()
    queries = placed.select("a", "b", "vec").join(query_keys, ["a", "b"], "left_semi")
    queries = queries.mapInArrow(wanted, f"a long, b long, vec {kind}, slots array<long>")
    hosts = placed.mapInArrow(dealt, f"a long, b long, vec {kind}, ids array<long>, slots array<long>")
    met = hosts.select(F.explode("slots").alias("slot"), F.lit(False).alias("query"), "a", "b", "vec", "ids").unionByName(
        queries.select(F.explode("slots").alias("slot"), F.lit(True).alias("query"), "a", "b", "vec", F.lit(None).cast("array<long>").alias("ids"))
    )
    best = met.repartition("slot").sortWithinPartitions("slot").mapInArrow(_rank_in_slot(k + 1), "qa long, qb long, ids array<long>, distance double")
    found = best.groupBy("qa", "qb", F.col("ids")[0].alias("first")).agg(F.any_value("ids").alias("ids"), F.min("distance").alias("score"))
    found = found.select("qa", "qb", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("qa", "qb").orderBy("score", "vec_id")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    # Equal queries have one result; each leaves out itself.
    found = found.groupBy("qa", "qb").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    out = asked.withColumnRenamed("vec_id", "query_id").join(found, (F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb")))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
