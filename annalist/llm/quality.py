"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A document becomes hashed counts of its words, of the shapes of its blank-free
chunks (``Word,`` is ``Aa,``) and of coarse statistics of the whole text. Chunks
of more than ``PIECE`` characters, as in texts without blanks, are cut into
consecutive pieces that all count, as do all their character trigrams. On a
bounded sample of labelled rows, at most ``MAX_PER_CLASS`` of each class, these
are weighted by log count and inverse document frequency and reduced by a
singular value decomposition. The labelled vectors and the projection (both of a
fixed greatest size) are broadcast; every document is compared with all labelled
vectors in blocks of exact cosine products, and its ``NEIGHBOURS`` nearest vote
with their similarity. The score is the share of label 1 in those votes.

Defined cases: a null text counts as empty; an empty text, or one nearest to
nothing, has the score 0.0; ties in similarity go to the sampled row with the
smaller id; repeated labels of a document count once (label 1 if their mean is
0.5 or more), null labels not at all; with no labels of a class at hand, every
score is that of the other class, and 0.0 with none at all; repeated rows each
get a score; an empty table gives an empty result; texts of any length are read
whole, in linear time; columns other than doc_id and text are not read, whatever
their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Fitted, fit_in_task, held_out

MAX_PER_CLASS = 1200
BUCKETS = 1 << 14
DIMENSIONS, NEIGHBOURS = 48, 9
ACCEPT = 0.7
CACHE_CHUNKS = 120_000
PIECE = 64

_STRIP = re.compile(r"^\W+|\W+$")
_RUNS = re.compile(r"(.)\1{2,}", re.S)


def _shape(chunk: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in chunk)
    return _RUNS.sub(r"\1\1", re.sub(r"A+", "A", re.sub(r"a+", "a", out)))


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class Features:
    """Hashed term counts of texts; pieces of chunks are looked at once."""

    def __init__(self) -> None:
        self._cache: dict[str, tuple[int, int]] = {}

    def _chunk(self, chunk: str) -> tuple[int, int]:
        got = self._cache[chunk] = (_bucket("w:" + _STRIP.sub("", chunk).lower()), _bucket("s:" + _shape(chunk)))
        return got

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets in order and how often each occurs."""
        chunks = (text or "").split()
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self._cache) > CACHE_CHUNKS:
            self._cache.clear()
        known, look = self._cache.get, self._chunk
        if max(map(len, chunks)) <= PIECE:
            pairs = np.array([known(c) or look(c) for c in chunks], np.int64)
            distinct, grams = len(np.unique(pairs[:, 0])), np.zeros(0, np.int64)
        else:
            cut = [[known(p) or look(p) for p in (c[i : i + PIECE] for i in range(0, len(c), PIECE))] for c in chunks]
            pairs = np.array([p for ps in cut for p in ps], np.int64)
            distinct, grams = len({tuple(w for w, _ in ps) for ps in cut}), self._trigrams(c for c in chunks if len(c) > PIECE)
        shapes = pairs[:, 1]
        two = (shapes[:-1] * 31 + shapes[1:] + 7) % BUCKETS
        idx, n = np.unique(np.concatenate([pairs.ravel(), two, grams]), return_counts=True)
        told = np.array([_bucket(f"t:{k}:{v}") for k, v in self._statistics(text, chunks, distinct)])
        return np.concatenate([idx, told]), np.concatenate([n, np.full(len(told), max(1.0, len(chunks) / 4))])

    @staticmethod
    def _trigrams(chunks: Iterable[str]) -> np.ndarray:
        """The bucket of each character trigram, as often as it occurs."""
        seen = Counter(c[i : i + 3] for c in map(str.lower, chunks) for i in range(len(c) - 2))
        return np.repeat(np.array([_bucket("g:" + g) for g in seen], np.int64), list(seen.values()))

    @staticmethod
    def _statistics(text: str, chunks: list[str], distinct: int) -> Iterator[tuple[str, int]]:
        n = len(chunks)
        lines = [x for x in text.split("\n") if x.strip()]
        yield "chunk", int(4 * np.log2(1 + len(text) / n))
        yield "once", int(10 * distinct / n)
        yield "lines", int(10 * len(set(lines)) / max(1, len(lines)))
        yield "line", int(np.log2(1 + len(text) / max(1, len(lines))))
        yield "size", int(np.log2(1 + n))


class Model:
    """Projection, labelled vectors and labels; all of bounded size."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def _weights(self, idx: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[idx]
        size = np.sqrt((w * w).sum())
        return w / size if size else w

    def vector(self, idx: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = self._weights(idx, n) @ self.basis[idx] if len(idx) else np.zeros(self.basis.shape[1])
        size = np.sqrt((v * v).sum())
        return v / size if size else v

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """The share of label 1 in the votes of the nearest labelled vectors."""
        if not len(self.labels) or not len(vectors):
            return np.zeros(len(vectors))
        sims = np.maximum(vectors @ self.vectors.T, 0.0)
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argsort(-sims, axis=1, kind="stable")[:, :k] if len(self.labels) <= 4 * k else self._nearest(sims, k)
        votes = np.take_along_axis(sims, near, 1)
        total = votes.sum(1)
        return np.where(total > 0, (votes * self.labels[near]).sum(1) / np.where(total > 0, total, 1), 0.0)

    @staticmethod
    def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
        some = np.sort(np.argpartition(-sims, 2 * k, axis=1)[:, : 2 * k], axis=1)
        order = np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable")[:, :k]
        return np.take_along_axis(some, order, 1)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: Sequence[int], dimensions: int = DIMENSIONS) -> Model:
    """Fit on the term counts and labels of the sampled rows."""
    n = len(rows)
    df = np.zeros(BUCKETS)
    for idx, _ in rows:
        df[np.unique(idx)] += 1
    used = np.flatnonzero(df >= min(2, n))
    idf = np.zeros(BUCKETS, np.float32)
    idf[used] = np.log((1 + n) / (1 + df[used])) + 0.1
    model = Model(idf, np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1)), np.zeros(0))
    if not n or not len(used):
        return model
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    a = np.zeros((n, len(used)), np.float32)
    for k, (idx, c) in enumerate(rows):
        keep = place[idx] >= 0
        np.add.at(a[k], place[idx[keep]], model._weights(idx, c)[keep])
    d = min(dimensions, n, len(used))
    q = np.linalg.qr(a @ (a.T @ np.random.default_rng(7).standard_normal((n, min(n, d + 16))).astype(np.float32)))[0]
    for _ in range(2):
        q = np.linalg.qr(a @ (a.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    basis = np.zeros((BUCKETS, d), np.float32)
    basis[used] = vt[:d].T
    model.basis = basis
    model.vectors = np.array([model.vector(*r) for r in rows])
    model.labels = np.array(labels, float)
    return model


def _labelled(docs: DataFrame, labels: DataFrame, max_per_class: int) -> DataFrame:
    """doc_id, label, text of a bounded sample of labelled rows outside the held-out ones."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    take = F.lit(False)
    for label, n in sizes.items():
        take |= (F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_per_class / n)))
    return F.broadcast(own.where(take)).join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for b in batches:
        rows = [features.counts(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64()))],
            names=["doc_id", "label", "idx", "n"],
        )


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Fitted:
    """A model from the sampled labelled rows, made in one task of their hashed
    counts, at most 2 * max_per_class * BUCKETS numbers."""
    sample = _labelled(docs, labels, max_per_class).mapInArrow(_counted, "doc_id long, label int, idx array<long>, n array<double>")

    def made(batches: list[pa.RecordBatch]) -> Model:
        if not batches:
            return train([], [])
        t = pa.Table.from_batches(batches).combine_chunks().sort_by("doc_id").combine_chunks()
        idx, n = (t.column(c).chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("idx", "n"))
        at = idx.offsets.to_numpy()
        one, two = idx.values.to_numpy(), n.values.to_numpy()
        return train([(one[s:e], two[s:e]) for s, e in zip(at, at[1:], strict=False)], t.column("label").to_pylist())

    return fit_in_task(sample, made)


def score(docs: DataFrame, model: Fitted, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, score, and the columns named in ``keep`` as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *(F.col(f"`{f.name}`") for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value.model, Features()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                vectors = [m.vector(*features.counts(t)) for t in b.column(1).to_pylist()]
                found = m.scores(np.array(vectors).reshape(len(vectors), -1)) if vectors else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(found, 0, 1)), *b.columns[2:]], names=["_id", "_score", *b.schema.names[2:]])

    schema = rows.schema.fields
    out = rows.mapInArrow(run, ", ".join(["_id long", "_score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in schema[2:])]))
    return out


def keep_good(docs: DataFrame, model: Fitted, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is ``accept`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value.model, Features()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                vectors = np.array([m.vector(*features.counts(t)) for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(m.scores(vectors.reshape(b.num_rows, -1)) >= accept))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The query contract: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, max_per_class))
    return scored.select(F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= ACCEPT).cast("int").alias("predicted"))
