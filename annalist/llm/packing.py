"""Best-fit packing: few-document length patterns fitted to the length histogram.

Documents are tokenised once; only (doc_id, piece, start, length, digest) rows go
on. The plan is made on the driver from the histogram of piece lengths, which
has at most ``capacity`` entries however large the corpus is:

1. patterns of up to four lengths that fill a sequence (nearly) exactly are
   enumerated, and their repeat counts are fitted to the histogram by
   non-negative least squares (multiplicative updates);
2. the counts are rounded and cut to what is there;
3. what is left is packed largest first, whole multiples of a pattern at a time,
   which gives the sequences of first-fit-decreasing.

Each pattern takes ranges of ranks within its lengths, so that a piece finds its
sequence and offset from its length and its rank alone. Ranks are counted in
(length, salt) groups of bounded size with prefix sums over the salts, so that a
length which most pieces share is spread out.

Defined cases: a null text is an empty one; an empty document is its end id
alone; a longer document than a sequence is cut into pieces of ``capacity`` ids,
the last of which may be shorter; repeated rows are pieces of their own; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY, END_ID = 4096, 1
#: Pieces in a (length, salt) group, about; the number of salts follows the input.
GROUP_ROWS = 100_000
#: Distinct chunks of text in a generation of the cache.
CACHE_CHUNKS = 400_000

# A run of letters before white space or an ASCII sign, else all up to white space.
_CHUNK = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|$)|[^ \n\t\r]+")


class _ChunkTokenizer:
    """Token ids of texts, chunk by chunk. The tokenizer drops white space, cuts
    words where letters end, and no normalisation reaches over those places, so
    the ids of a text are those of its chunks, each of which is tokenised once
    while it stays in one of the cache's two generations."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._inner, self._cache, self._older = Tokenizer.from_file(path), {}, {}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [_CHUNK.findall(_lowered(t)) if t else [] for t in texts]
        if len(self._cache) > CACHE_CHUNKS:
            self._older, self._cache = self._cache, {}
        seen: set[str] = set()
        for cs in cut:
            seen.update(cs)
        new = []
        for c in seen.difference(self._cache):
            if (known := self._older.get(c)) is None:
                new.append(c)
            else:
                self._cache[c] = known
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for c, e in zip(some, self._inner.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self._cache[c] = _little(e.ids)
        return [b"".join(map(self._cache.__getitem__, cs)) for cs in cut]


def _lowered(text: str) -> str:
    """Lower case where that is what the tokenizer makes of each character, so
    that more chunks are alike. Texts with ``<|`` stay as they are: special tokens
    match in exact case."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _little(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> _ChunkTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
    return _ChunkTokenizer(path)


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if
    asked for, the ids themselves."""
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out: list[list] = [[] for _ in names]
                for doc, ids in zip(b.column(0).to_pylist(), tok.ids(b.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        row = (doc, piece, start // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32))
                        for c, v in zip(out, row, strict=False):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Pattern(NamedTuple):
    """``repeats`` sequences, each holding ``lengths`` = ((length, times), ...) in order."""

    lengths: tuple[tuple[int, int], ...]
    repeats: int


def enumerate_patterns(lengths: list[int], capacity: int, slack: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to four of the lengths that leave at most ``slack`` free:
    every length as the largest, a spread of second and third ones, and each time
    the best fitting last one."""
    rising = sorted(lengths)
    out: set[tuple[int, ...]] = set()

    def best(most: int) -> int | None:
        at = bisect_right(rising, most)
        return rising[at - 1] if at else None

    def spread(most: int, n: int) -> list[int]:
        at = bisect_right(rising, most)
        return [rising[int(k)] for k in np.unique(np.linspace(0, at - 1, n))] if at else []

    def offer(*head: int) -> None:
        room = capacity - sum(head)
        last = best(min(room, head[-1]) if head else room) if room > 0 else None
        if room <= slack:
            out.add(head)
        elif last is not None and room - last <= slack:
            out.add((*head, last))

    for a in rising:
        if 4 * a < capacity - slack:
            continue
        offer(a)
        for b in spread(min(a, capacity - a), 16):
            offer(a, b)
        for b in spread(min(a, capacity - a), 6):
            for c in spread(min(b, capacity - a - b), 6):
                offer(a, b, c)
    return sorted(out, reverse=True)


def fit_repeats(patterns: list[tuple[int, ...]], histogram: dict[int, int], rounds: int = 150) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram."""
    lengths = sorted(histogram)
    row = {x: i for i, x in enumerate(lengths)}
    rows = np.array([row[x] for p in patterns for x in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    h = np.array([histogram[x] for x in lengths], float)
    gain = np.bincount(cols, h[rows], len(patterns))
    x = np.bincount(cols, (h / np.maximum(np.bincount(rows, minlength=len(h)), 1))[rows], len(patterns)) / np.array([len(p) for p in patterns])
    for _ in range(rounds):
        fitted = np.bincount(rows, x[cols], len(h))
        x *= gain / np.maximum(np.bincount(cols, fitted[rows], len(patterns)), 1e-12)
    return x


def pack_rest(left: dict[int, int], capacity: int) -> list[Pattern]:
    """First-fit-decreasing over counts: the largest length there is, then ever
    the largest that fits, and as many such sequences at once as the counts allow."""
    rising = sorted(k for k, n in left.items() if n)
    left, out = dict(left), []
    while rising:
        room, at, pattern = capacity, len(rising) - 1, []
        while at >= 0:
            x = rising[at]
            times = min(room // x, left[x])
            if times:
                pattern.append((x, times))
                room -= x * times
            at = min(at, bisect_right(rising, room)) - 1
        repeats = min(left[x] // n for x, n in pattern)
        out.append(Pattern(tuple(pattern), repeats))
        for x, n in pattern:
            left[x] -= n * repeats
            if not left[x]:
                rising.pop(bisect_right(rising, x) - 1)
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """The sequences that hold all pieces of the histogram."""
    left, out = {k: n for k, n in histogram.items() if n}, []
    patterns = enumerate_patterns(list(left), capacity)
    if patterns:
        repeats = np.rint(fit_repeats(patterns, left)).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable").tolist():
            if repeats[k] < 1:
                break
            need: dict[int, int] = {}
            for x in patterns[k]:
                need[x] = need.get(x, 0) + 1
            n = min(int(repeats[k]), *(left[x] // m for x, m in need.items()))
            if n:
                out.append(Pattern(tuple(need.items()), n))
                for x, m in need.items():
                    left[x] -= m * n
    return out + pack_rest(left, capacity)


def _ranges(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for x, times in p.lengths:
            rows.append((x, taken.get(x, 0), times, sequence, offset))
            taken[x] = taken.get(x, 0) + times * p.repeats
            offset += x * times
        sequence += p.repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table that is there, with doc_id, piece and length) with
    sequence_id and offset. Only the length histogram comes to the driver."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    ranges = _ranges(plan(histogram, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(ranges)
    salts = max(1, total // GROUP_ROWS)
    own = [c for c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_salt"])
    ranked = ranked.select(*own, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("_rank"))
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        reach = int(r[:, 1].max()) + 1 if len(r) else 1
        starts = r[:, 0] * reach + r[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            hit = r[np.searchsorted(starts, length * reach + np.minimum(rank, reach - 1), side="right") - 1]
            nth = rank - hit[:, 1]
            sequence, offset = hit[:, 3] + nth // hit[:, 2], hit[:, 4] + nth % hit[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return pack(materialise(tokenise(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
