"""SentencePiece (BPE) encoding and decoding with vectorised merge rounds.

Texts are cut before each run of the space mark; when no piece of the model has
a mark behind another character, no merge can cross such a cut, so words are
encoded on their own, each distinct one once per batch, and a bounded cache
keeps them between batches. All new words of a batch go through the rounds
together: flat symbol arrays, the least pair rank per word by segment, all
leftmost non-overlapping pairs of that rank merged at once, then compaction,
until no word has a pair left. The library merges one pair at a time, so a word
in which one of the merges would make a pair that goes before the others merges
only its leftmost pair in that round (a long such word goes through a queue);
results are then the library's.

Defined cases: a null text counts as empty; an empty text gives only the end id
and decodes to the empty text; characters without a piece become bytes (or the
unknown id if the model has no bytes); repeated rows each get a result; columns
but the id and the text are not read. Memory is linear in a batch's text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_FAR = np.int64(1 << 62)
#: Distinct words in a generation of the cache kept between batches.
CACHE_WORDS = 300_000

codecs.register_error("annalist-bytewise", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A BPE piece model read from its file."""

    def __init__(self, path: str) -> None:
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as f:
            for n, v in _fields(f.read()):
                if n == 1:
                    d = dict(_fields(v))
                    pieces.append((d[1].decode("utf-8"), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, _NORMAL)))
                elif n == 2:
                    trainer = dict(_fields(v))
                elif n == 3:
                    normalizer = dict(_fields(v))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0) or any(t in (_USER, _UNUSED) for _, _, t in pieces):
            raise ValueError("the model normalises text or holds user symbols, which this encoder doesn't")
        self.prefix = bool(normalizer.get(3, 1))
        self.size = len(pieces)
        self.texts = [p for p, _, _ in pieces]
        self.unk = next(i for i, p in enumerate(pieces) if p[2] == _UNKNOWN)
        self.end = next((i for i, p in enumerate(pieces) if p[0] == "</s>"), None)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == _BYTE}
        self.is_byte = [t == _BYTE for _, _, t in pieces]
        ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == _NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError("pieces cross word starts")
        self._char = {p: i for p, i in ids.items() if len(p) == 1}
        self._base = self.size + 0x110000
        scores = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
        keys, ranks, made = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if (len(a) == 1 or a in ids) and (len(b) == 1 or b in ids):
                    keys.append(self._symbol(a, ids) * self._base + self._symbol(b, ids))
                    ranks.append(scores[pieces[i][1]])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self._keys = np.array(keys, np.int64)[order]
        self._ranks = np.array(ranks, np.int64)[order]
        self._made = np.array(made, np.int64)[order]
        self._words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._by_pair: dict[int, tuple[int, int]] = {}
        self._decimal = [str(i) for i in range(self.size)]
        self._out = [b"" if t == _CONTROL else " ⁇ ".encode() if t == _UNKNOWN else bytes([int(p[3:5], 16)]) if t == _BYTE else p.replace(MARK, " ").encode() for p, _, t in pieces]

    def _symbol(self, p: str, ids: dict[str, int]) -> int:
        return ids[p] if p in ids else self.size + ord(p)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of each pair; rank _FAR where there is none."""
        keys = left * self._base + right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        there = self._keys[at] == keys
        return np.where(there, self._ranks[at], _FAR), self._made[at]

    def _rank_at(self, at: np.ndarray, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Set rank and made of the pairs that begin at the given places."""
        rank[at] = _FAR
        at = at[at + 1 < len(sym)]
        at = at[seg[at] == seg[at + 1]]
        rank[at], made[at] = self._ranked(sym[at], sym[at + 1])

    def merge_words(self, words: Sequence[str]) -> list[bytes]:
        """Piece ids (int32) of each word, without the prefix rule, in merge rounds."""
        lens = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        distinct, back = np.unique(points, return_inverse=True)
        sym = np.array([self._char.get(chr(c), self.size + c) for c in distinct.tolist()], np.int64)[back] if len(points) else points
        seg = np.repeat(np.arange(len(words)), lens)
        rank, made = np.full(len(sym), _FAR), np.zeros(len(sym), np.int64)
        self._rank_at(np.arange(len(sym)), sym, seg, rank, made)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != _FAR, sizes)
            if not live.all():  # compaction
                ended.append((sym[~live], seg[~live]))
                sym, seg, rank, made = sym[live], seg[live], rank[live], made[live]
            floor = np.repeat(least, sizes)[live]
            hit = np.flatnonzero(rank == floor)
            if not len(hit):
                break
            # Of hits at consecutive places, every second one overlaps the one before.
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])]
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            clash = self._clashing(sym, seg, made, floor, hit)
            if len(clash):
                first = np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]
                hit = hit[first | ~np.isin(seg[hit], clash)]
                long = clash[np.bincount(seg, minlength=len(words))[clash] > 64]
                if len(long):  # one merge a round would take too many rounds
                    for w in long.tolist():
                        span = np.flatnonzero(seg == w)
                        one_by_one = np.array(self._merge_in_turn(sym[span].tolist()), np.int64)
                        ended.append((one_by_one, np.full(len(one_by_one), w)))
                    rest = ~np.isin(seg, long)
                    moved = np.cumsum(rest) - 1
                    hit = moved[hit[rest[hit]]]
                    sym, seg, rank, made = sym[rest], seg[rest], rank[rest], made[rest]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
            self._rank_at(np.unique(np.r_[at, at[at > 0] - 1]), sym, seg, rank, made)
        if not ended:
            return [b""] * len(words)
        flat, of = self._spell(np.concatenate([x[0] for x in ended]), np.concatenate([x[1] for x in ended]))
        order = np.argsort(of, kind="stable")
        data = flat[order].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(of, minlength=len(words))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _clashing(self, sym: np.ndarray, seg: np.ndarray, made: np.ndarray, floor: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """The words in which merging all hits at once is not what merging them
        in turn gives: one of the merges makes a pair that would go first."""
        several = np.r_[False, seg[hit[1:]] == seg[hit[:-1]]]
        several[:-1] |= several[1:]
        if not several.any():
            return hit[:0]
        hit = hit[several]
        new, after = made[hit], hit + 2
        right, left = np.full(len(hit), -1), np.full(len(hit), -1)
        k = np.flatnonzero((after < len(sym)) & (seg[np.minimum(after, len(sym) - 1)] == seg[hit]))
        right[k] = sym[after[k]]
        k = np.flatnonzero((hit > 0) & (seg[np.maximum(hit - 1, 0)] == seg[hit]))
        left[k] = sym[hit[k] - 1]
        k = np.flatnonzero(np.r_[False, (hit[1:] == hit[:-1] + 2) & (seg[hit[1:]] == seg[hit[:-1]])])
        left[k] = new[k - 1]
        worse = np.zeros(len(hit), bool)
        for a, b in ((left, new), (new, right)):
            k = np.flatnonzero((a >= 0) & (b >= 0))
            worse[k] |= self._ranked(a[k], b[k])[0] <= floor[hit[k]]
        return np.unique(seg[hit[worse]])

    def _merge_in_turn(self, sym: list[int]) -> list[int]:
        """One word by a queue of pairs: the best rank first, then the leftmost."""
        table = self._table()
        before, after, queue = [*range(-1, len(sym) - 1)], [*range(1, len(sym)), -1], []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (got := table.get(sym[i] * self._base + sym[j])):
                heapq.heappush(queue, (got[0], i, j, sym[i], sym[j], got[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b, made = heapq.heappop(queue)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in sym if x >= 0]

    def _table(self) -> dict[int, tuple[int, int]]:
        if not self._by_pair:
            self._by_pair.update(zip(self._keys.tolist(), zip(self._ranks.tolist(), self._made.tolist(), strict=True), strict=True))
        return self._by_pair

    def _spell(self, sym: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, of
        spelt = [[self.bytes[b] for b in chr(s - self.size).encode("utf-8")] if self.bytes else [self.unk] for s in sym[odd].tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(x) for x in spelt]
        out = np.repeat(sym, times)
        out[np.repeat(sym >= self.size, times)] = [i for x in spelt for i in x]
        return out, np.repeat(of, times)

    def encode_batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them, without an end id."""
        cut = [self._words.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self._cache) > CACHE_WORDS:
            self._older, self._cache = self._cache, {}
        seen: set[str] = set()
        for ws in cut:
            seen.update(ws)
        new = []
        for w in seen.difference(self._cache):
            if (known := self._older.get(w)) is None:
                new.append(w)
            else:
                self._cache[w] = known
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self._cache.update(zip(some, self.merge_words(some), strict=True))
        return [np.frombuffer(b"".join(map(self._cache.__getitem__, ws)), np.int32) for ws in cut]

    def decode(self, ids: Sequence[int]) -> str:
        """The library's decode(ids)."""
        parts = list(map(self._out.__getitem__, ids))
        if self.prefix:  # the first piece that says anything loses one leading space
            for k, i in enumerate(ids):
                if parts[k]:
                    if not self.is_byte[i] and i != self.unk and parts[k][:1] == b" ":
                        parts[k] = parts[k][1:]
                    break
        return b"".join(parts).decode("utf-8", "annalist-bytewise")

    def decimal(self, ids: Sequence[int]) -> str:
        return " ".join(map(self._decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int>: every whole text, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            ids = [np.append(x, np.int32(model.end)) for x in model.encode_batch(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text out of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            texts = [model.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """The query contract: counts and digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for b in batches:
            for part in range(0, b.num_rows, 256):  # ids of a few texts at a time
                some = b.slice(part, 256)
                out: list[list] = [[], [], []]
                for x in model.encode_batch(some.column(1).to_pylist()):
                    ids = [*x.tolist(), model.end]
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(model.decimal(ids).encode()).hexdigest())
                    out[2].append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
