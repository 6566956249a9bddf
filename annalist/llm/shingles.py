"""Exact n-gram Jaccard join of whole documents by PartEnum signatures.

Texts are lower-cased in A-Z and split at ASCII white space; a document's set
holds its distinct word shingles. Two documents link when the Jaccard similarity
of their sets reaches the threshold, exactly.

Sizes are cut into bands; two sets that link are in one band or in neighbouring
ones. For a band, the greatest symmetric difference of a linking pair is known.
The feature domain is hashed into first-level partitions, so many that a linking
pair differs by at most one element in one of them; each is cut in two again,
and the two ways of leaving one half out give two signatures per partition, one
of which is equal for the pair. Equal sets are one node from the start.

Signatures travel packed (4 bytes and a 2-byte place in a list of nodes), dealt
into parts by their hash. The nodes of one signature are a bucket; equal buckets
are looked at once. Within its own bucket every pair is held against a bound:
the parities of a set's elements, hashed into as many bits as it has elements or
more, differ in at most as many places as the sets do. Only what passes joins a
candidate group, so that a passage that many documents share connects none of
them. Each group's sets are then compared exactly.

Buckets and groups that outgrow a task are dealt out in blocks: first each block
with the pivot of the whole, afterwards only what the pivot doesn't connect
against the other blocks. What leaves a comparison are stars, never pairs.

Defined cases: a null or blank text has an empty set (size 0), links with
nothing and is its own component; a text of fewer words than a shingle has one
shingle, the whole sequence; repeated rows and copies share a set and hence a
component; columns but doc_id and text are not read; an empty table gives an
empty result. Memory is bounded by a batch of texts, a part of signatures or two
blocks of sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import discard, materialise, mix64, release
from .vectors import by_key

CACHE_WORDS = 150_000
#: Sets in a block of a large candidate group, about.
BLOCK_ROWS = 1024
#: Nodes of a bucket that is compared in one piece.
BUCKET_ROWS = 8192
#: Signatures in a part, about; and those that a task packs or holds at once.
PART_ROWS, FLUSH_ROWS, HELD_ROWS = 1_000_000, 1_000_000, 4_000_000
#: Hash seeds tried before signatures of empty halves are given out.
SEEDS = 4
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)
        return got


class Shingler:
    """64-bit hashes of the distinct word shingles of texts."""

    def __init__(self, width: int) -> None:
        self.width, self._hashes = width, _WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        if len(self._hashes) > CACHE_WORDS:
            self._hashes.clear()
        out = []
        for t in texts:
            words = t.encode("utf-8").lower().split() if t else []
            h = np.fromiter(map(self._hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
            n = max(1, len(h) - self.width + 1) if len(h) else 0
            s = np.full(n, min(self.width, len(h)), np.uint64)
            for k in range(min(self.width, len(h))):
                s = mix64(s * _MUL[k % 3] + h[k : k + n] + np.uint64(k))
            out.append(np.unique(s))
        return out


class Bands:
    """Size bands and the PartEnum parameters of each, for one threshold."""

    def __init__(self, threshold: Fraction) -> None:
        self.threshold, self._ends, self._chosen = threshold, [1], {}

    def band(self, size: int) -> int:
        """Bands are wide enough that most sets are in one alone; a set links with
        none beyond the band after its own."""
        while self._ends[-1] < size:
            first = self._ends[-1] + 1
            self._ends.append(max(int(first / self.threshold), first * 7 // 5))
        return int(np.searchsorted(self._ends, size))

    def partitions(self, band: int) -> tuple[int, int, int]:
        """(first-level partitions, differing elements allowed in one of them,
        partitions with an empty half that a set may have) for pairs up to this
        band, the larger of which is in it.

        Of n partitions, more than n - (d + 1) // 2 differ by one element at most
        when a pair differs by d. So many spare ones are added that the halves of a
        set seldom leave more of them empty."""
        while band >= len(self._ends):
            self.band(self._ends[-1] + 1)
        if band not in self._chosen:
            top, typical = self._ends[band], 0.9 * (self._ends[band - 1] + 1 if band else 1)
            differ = int((1 - self.threshold) / (1 + self.threshold) * 2 * top)
            need, spare = (differ + 2) // 2, 0
            while spare < need:
                empty = 2 * (need + spare) * exp(-typical / 2 / (need + spare))
                if empty < 0.05 or empty + 1.3 * sqrt(empty) <= spare:
                    break
                spare += 1
            self._chosen[band] = (1, 0, 0) if differ == 0 else (need + spare, 1, spare)
        return self._chosen[band]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Signatures of a set: in its own band and, if sets that it can link with
        lie beyond that band's end, in the next."""
        if not len(shingles):
            return np.zeros(0, np.int64)
        own = self.band(len(shingles))
        bands = (own, own + 1) if len(shingles) / self.threshold > self._ends[own] else (own,)
        return np.unique(np.concatenate([x for b in bands for x in self._in_band(shingles, b)])).view(np.int64)

    def _in_band(self, shingles: np.ndarray, band: int) -> Iterator[np.ndarray]:
        """Empty halves would be equal for unrelated sets and have no signature. A
        pair that shares no other half has more partitions with empty halves than
        the spare ones on both sides, so such sets go on to the next seed; only the
        last seed gives out signatures of empty halves."""
        n, allowed, spare = self.partitions(band)
        value = mix64(shingles ^ _MUL[1])
        for seed in range(SEEDS):
            salt = (band * SEEDS + seed + 1) * int(_MUL[0]) % 2**64
            key = mix64(shingles + np.uint64(salt))
            at = ((key >> np.uint64(33)) % np.uint64(n) * np.uint64(allowed + 1) + ((key >> np.uint64(7)) & np.uint64(allowed))).astype(np.int64)
            sums = np.zeros(n * (allowed + 1), np.uint64)
            np.add.at(sums, at, value)
            there = np.bincount(at, minlength=len(sums)) > 0
            signatures = mix64(sums + mix64(np.arange(len(sums)).astype(np.uint64) * _MUL[2] + np.uint64(salt)))
            if seed == SEEDS - 1:
                yield signatures
                return
            yield signatures[there]
            if np.count_nonzero(~there.reshape(n, -1).all(1)) <= spare:
                return


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's elements in 2**k buckets, as many as elements or more,
    in 64-bit words. Two sets' parities differ in at most as many places as the
    sets differ in elements; halves of a longer one are folded by exclusive or."""
    size = max(64, 1 << int(len(shingles) - 1).bit_length())
    at = (mix64(shingles ^ _MUL[2]) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).view(np.uint64)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in ``data``."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_DESCRIBED = "doc_id long, n long, node long, bits binary, part long, signatures binary, places binary, nodes binary"


class _Packer:
    """Signatures of the sets of a task, packed by part."""

    def __init__(self, parts: int) -> None:
        self.parts, self.held, self.nodes, self.rows = parts, [], [], 0

    def add(self, node: int, signatures: np.ndarray) -> None:
        self.held.append(signatures.view(np.uint64))
        self.nodes.append(node)
        self.rows += len(signatures)

    def full(self) -> bool:
        return self.rows >= FLUSH_ROWS or len(self.nodes) >= 65_000

    def flush(self) -> Iterator[pa.RecordBatch]:
        """A row for each part: the low 32 bits of its signatures, the place of
        each one's node in the row's list, and that list."""
        if not self.rows:
            return
        all_ = np.concatenate(self.held)
        own = np.repeat(np.arange(len(self.nodes)), [len(x) for x in self.held])
        part = ((all_ >> np.uint64(32)) % np.uint64(self.parts)).astype(np.min_scalar_type(self.parts))
        order = np.argsort(part, kind="stable")
        part, own, low = part[order].astype(np.int64), own[order], (all_[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        names, starts = np.unique(part, return_index=True)
        ends = np.append(starts[1:], len(part))
        key = part * 65_536 + own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = key[new]
        node_starts = np.searchsorted(distinct, names * 65_536)
        place = np.cumsum(new) - 1 - np.repeat(node_starts, ends - starts)
        listed = np.array(self.nodes, np.int64)[distinct % 65_536]
        none = len(names)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(none, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array(names), _binaries(low, ends), _binaries(place.astype(np.uint16), ends), _binaries(listed, np.append(node_starts[1:], len(listed)))],
            names=["doc_id", "n", "node", "bits", "part", "signatures", "places", "nodes"],
        )
        self.held, self.nodes, self.rows = [], [], 0


def _parts(docs: DataFrame) -> int:
    """How many parts signatures are dealt into, by the length of all texts; it
    decides on the size of tasks alone."""
    length = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // 6 // PART_ROWS + 1))


def describe(docs: DataFrame, width: int, threshold: Fraction, parts: int) -> DataFrame:
    """A row for each document: doc_id, n (size of its set), node (fingerprint of
    the set; null if it is empty) and, for the first row of a set in a task, bits
    (its parities). Among them a row for each part and so many signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, seen, packer = Shingler(width), Bands(threshold), set(), _Packer(parts)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n, nodes, bits = [], [], []
                for s in shingler.sets(b.column(1).to_pylist()):
                    n.append(len(s))
                    nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                    fresh = len(s) and nodes[-1] not in seen
                    bits.append(_parities(s).tobytes() if fresh else None)
                    if fresh:
                        packer.add(nodes[-1], bands.signatures(s))
                        if len(seen) < 200_000:
                            seen.add(nodes[-1])
                        if packer.full():
                            yield from packer.flush()
                empty = [pa.nulls(b.num_rows, k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), *empty], names=["doc_id", "n", "node", "bits", "part", "signatures", "places", "nodes"])
        yield from packer.flush()

    return _texts(docs).mapInArrow(run, _DESCRIBED)


class _Part:
    """The signatures of one part, and the buckets in them. Those of a signature
    that outgrows a bucket leave early, so that memory follows the part's size."""

    def __init__(self, part: int) -> None:
        self.part, self.low, self.nodes, self.rows, self.large, self.chunk = part, [], [], 0, np.zeros(0, np.uint32), 0

    def add(self, low: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.large):
            known = np.isin(low, self.large)
            yield from self._told(low[known], nodes[known])
            low, nodes = low[~known], nodes[~known]
        self.low.append(low)
        self.nodes.append(nodes)
        self.rows += len(low)
        if self.rows > HELD_ROWS:
            yield from self._shrink()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low, nodes = np.concatenate(self.low), np.concatenate(self.nodes)
        order = np.lexsort((nodes, low))
        low, nodes = low[order], nodes[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (nodes[1:] != nodes[:-1])
        low, nodes = low[new], nodes[new]
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return low, nodes, starts, np.diff(np.append(starts, len(low)))

    def _told(self, low: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Members of large buckets, a row for some of them."""
        for x in np.unique(low):
            own = np.unique(nodes[low == x])
            name = int(mix64(np.array([self.part << 32 | int(x)], np.uint64)).view(np.int64)[0])
            for at in range(0, len(own), 4096):
                self.chunk += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([self.chunk]), pa.array([own[at : at + 4096]], pa.list_(pa.int64()))], names=_BUCKET_NAMES)

    def _shrink(self) -> Iterator[pa.RecordBatch]:
        low, nodes, starts, sizes = self._sorted()
        gone = np.repeat(sizes > BUCKET_ROWS, sizes)
        self.large = np.concatenate([self.large, low[starts[sizes > BUCKET_ROWS]]])
        yield from self._told(low[gone], nodes[gone])
        self.low, self.nodes, self.rows = [low[~gone]], [nodes[~gone]], int((~gone).sum())

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        yield from self._shrink()
        if not self.rows:
            return
        _, nodes, starts, sizes = self._sorted()
        # The members' hashes add up to a bucket's name; of equal ones the first stays.
        name = np.add.reduceat(mix64(nodes.view(np.uint64)), starts)
        shared = np.flatnonzero(sizes > 1)
        _, first = np.unique(name[shared], return_index=True)
        take = shared[first]
        for at in range(0, len(take), 10_000):
            some = take[at : at + 10_000]
            ends = np.concatenate([[0], np.cumsum(sizes[some])])
            rows = np.repeat(starts[some] - ends[:-1], sizes[some]) + np.arange(ends[-1])
            members = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(nodes[rows]))
            yield pa.RecordBatch.from_arrays([pa.array(name[some].view(np.int64)), pa.array(np.zeros(len(some), np.int64)), members], names=_BUCKET_NAMES)


_BUCKET_NAMES = ["bucket", "chunk", "members"]


def _buckets(described: DataFrame, parts: int) -> DataFrame:
    """bucket, chunk, members: what shares a signature, once each, with chunk 0. A
    bucket beyond BUCKET_ROWS comes in chunks from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for part, low, places, nodes in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if now is None or part != now.part:
                    if now:
                        yield from now.finish()
                    now = _Part(part)
                yield from now.add(np.frombuffer(low, np.uint32), np.frombuffer(nodes, np.int64)[np.frombuffer(places, np.uint16)])
        if now:
            yield from now.finish()

    packed = described.where("part is not null").select("part", "signatures", "places", "nodes")
    found = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "bucket long, chunk long, members array<long>")
    return found.dropDuplicates(["bucket", "chunk"])


class _Compared:
    """Sets that are compared with each other: by their parities, which rule pairs
    out, and, where the sets are there, in full."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes], threshold: Fraction, sets: list[np.ndarray] | None = None) -> None:
        self.sizes, self.sets = sizes, sets
        self.p, self.q = threshold.numerator, threshold.denominator
        words = np.array([len(x) // 8 for x in bits], np.int64)
        self.place, self.words, self.rows = np.zeros(len(bits), np.int64), words, {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(bits[k] for k in own.tolist()), np.uint64).reshape(-1, w)

    @classmethod
    def of(cls, sets: list[np.ndarray], threshold: Fraction) -> _Compared:
        return cls(np.array([len(s) for s in sets], np.int64), [_parities(s).tobytes() for s in sets], threshold, sets)

    def passing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs (x[i], y[i]) (may) reach the threshold, as places i."""
        p, q = self.p, self.q
        nx, ny = self.sizes[x], self.sizes[y]
        at = np.flatnonzero((ny * q >= nx * p) & (nx * q >= ny * p))
        short, long = np.where(self.words[x[at]] <= self.words[y[at]], (x[at], y[at]), (y[at], x[at]))
        differ = np.zeros(len(at), np.int64)
        code = self.words[short] << 32 | self.words[long]
        for c in np.unique(code).tolist():
            w, v = c >> 32, c & 0xFFFFFFFF
            those = np.flatnonzero(code == c)
            for k in range(0, len(those), max(1, (1 << 20) // v)):
                some = those[k : k + max(1, (1 << 20) // v)]
                one, two = self.rows[w][self.place[short[some]]], self.rows[v][self.place[long[some]]]
                if v > w:
                    two = np.bitwise_xor.reduce(two.reshape(len(some), v // w, w), axis=1)
                differ[some] = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
        at = at[(q + p) * differ <= (q - p) * (self.sizes[x[at]] + self.sizes[y[at]])]
        if self.sets is None or not len(at):
            return at
        found = np.fromiter((self._common(a, b) for a, b in zip(x[at].tolist(), y[at].tolist(), strict=True)), np.int64, len(at))
        return at[q * found >= p * (self.sizes[x[at]] + self.sizes[y[at]] - found)]

    def _common(self, a: int, b: int) -> int:
        one, two = self.sets[a], self.sets[b]
        return int(np.count_nonzero(one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two))

    def linked(self, k: int, these: np.ndarray) -> np.ndarray:
        """Which of ``these`` (may) reach the threshold with row k."""
        return these[self.passing(np.full(len(these), k), these)]


def _stars(ids: list[int], compared: _Compared, right: int | None = None, first: int = 0) -> list[tuple[int, int]]:
    """Star edges that connect what links among the rows from ``first`` on. With
    ``right``, only links between the rows before that place and those from it
    count. A row that is reached already is compared with unreached ones alone."""
    left = np.arange(len(ids)) < (right if right is not None else 0)
    free, edges = np.ones(len(ids), bool), []
    for seed in range(first, len(ids)):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            k = queue.pop()
            rest = np.flatnonzero(free if right is None else free & (left != left[k]))
            for x in compared.linked(k, rest).tolist():
                free[x] = False
                queue.append(x)
                edges.append((ids[seed], ids[x]))
    return edges


_EDGES = "u long, v long"


def _edges_batch(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _tied(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of the n places that each one reaches over the pairs (x, y)."""
    label = np.arange(n)
    while len(x):
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _within_buckets(threshold: Fraction):
    """For rows (bucket, doc_id, n, bits) sorted by bucket: star edges of what
    passes within a bucket. Small buckets are compared together."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, bucket, sizes = (t.column(c).to_numpy() for c in ("doc_id", "bucket", "n"))
        compared = _Compared(sizes, t.column("bits").to_pylist(), threshold)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        many = np.diff(np.append(starts, len(bucket)))
        small = many <= 64
        x, y = [], []
        for size in np.unique(many[small]).tolist():
            i, j = np.triu_indices(size, 1)
            own = starts[small & (many == size)]
            x.append((own[:, None] + i).ravel())
            y.append((own[:, None] + j).ravel())
        if x:
            x, y = np.concatenate(x), np.concatenate(y)
            at = compared.passing(x, y)
            label = _tied(x[at], y[at], len(ids))
            far = np.flatnonzero(label != np.arange(len(ids)))
            yield _edges_batch(ids[label[far]], ids[far])
        for s, n in zip(starts[~small].tolist(), many[~small].tolist(), strict=True):
            own = _Compared(sizes[s : s + n], t.column("bits").slice(s, n).to_pylist(), threshold)
            if edges := _stars(ids[s : s + n].tolist(), own):
                yield _edges_batch(*zip(*edges, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("bucket").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if held and (last or held[-1].column("bucket")[0].as_py() != key[0]):
                yield from compare(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            elif last:
                yield from compare(pa.Table.from_batches([b.slice(0, last)]))
            held.append(b.slice(last))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def _blocked_stars(members: DataFrame, load: Callable[[DataFrame], DataFrame], threshold: Fraction, block_rows: int) -> DataFrame:
    """Star edges (u, v) that connect what links within each group of ``members``
    (part, doc_id). ``load`` adds n, bits and set to rows with a doc_id; where
    sets are there they decide, else the parities. Groups beyond ``block_rows``
    are dealt out in blocks."""
    sized = members.groupBy("part").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"), F.min("doc_id").alias("pivot"), F.count("*").alias("many"))
    dealt = members.join(sized.where("many > 1").drop("many"), "part").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = materialise(load(dealt), "dealt")

    def compared(t: pa.Table) -> _Compared:
        sets = t.column("set").to_pylist()
        if sets[0] is not None:
            return _Compared.of([np.frombuffer(x, np.uint64) for x in sets], threshold)
        return _Compared(t.column("n").to_numpy(), t.column("bits").to_pylist(), threshold)

    def within(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        if t.num_rows > 1 and (edges := _stars(t.column("doc_id").to_pylist(), compared(t))):
            yield _edges_batch(*zip(*edges, strict=True))

    def across(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        guests = int(np.count_nonzero(t.column("guest").to_numpy(zero_copy_only=False)))
        if 0 < guests < t.num_rows and (edges := _stars(t.column("doc_id").to_pylist(), compared(t), guests)):
            yield _edges_batch(*zip(*edges, strict=True))

    columns = ("part", "block", "doc_id", "n", "bits", "set")
    # Each block of a group, and in each the group's pivot.
    pivots = dealt.where("doc_id = pivot and blocks > 1")
    guests = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where(F.pmod(F.xxhash64("doc_id"), F.col("blocks")) != F.col("block"))
    first = dealt.select(*columns).unionByName(guests.select(*columns))
    first = materialise(first.repartition("part", "block").sortWithinPartitions("part", "block", "doc_id").mapInArrow(by_key(["part", "block"], within), _EDGES), "links")
    if pivots.isEmpty():
        discard(dealt)
        return first
    # What the pivot doesn't connect, against all blocks of its group.
    reached = components(first).select(F.col("node").alias("doc_id"), F.col("component"))
    reached = materialise(dealt.where("blocks > 1").select("part", "doc_id", "pivot", "block", "blocks").join(reached, "doc_id", "left"), "reached")
    joined = reached.where("doc_id = pivot").select("part", F.coalesce("component", "pivot").alias("own"))
    apart = reached.join(joined, "part").where(F.coalesce("component", "doc_id") != F.col("own"))
    # As many chunks of a block's rest as keep them within a block's size.
    chunks = apart.groupBy("part", "block").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("chunks"))
    apart = materialise(apart.join(chunks, ["part", "block"]).select("part", "doc_id", "blocks", (F.col("block") * 1_000_000 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("chunks"))).alias("chunk")), "apart")
    if apart.isEmpty():
        return first
    visitors = dealt.drop("block", "blocks").join(apart, ["part", "doc_id"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    hosts = dealt.join(apart.select("part", "chunk").distinct(), "part")
    met = visitors.select(*columns, "chunk", F.lit(True).alias("guest")).unionByName(hosts.select(*columns, "chunk", F.lit(False).alias("guest")))
    met = met.repartition("part", "block", "chunk").sortWithinPartitions("part", "block", "chunk", F.desc("guest"), "doc_id")
    second = materialise(met.mapInArrow(by_key(["part", "block", "chunk"], across), _EDGES).where("u <> v"), "links")
    discard(dealt)
    return first.unionByName(second)


def _candidates(buckets: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """doc_id, part: the groups of nodes (by their least doc_id) that parities
    within shared buckets connect. nodes: node, doc_id, n, bits."""
    told = buckets.where("chunk = 0").select("bucket", F.explode("members").alias("node")).join(nodes, "node").select("bucket", "doc_id", "n", "bits")
    edges = told.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_within_buckets(threshold), _EDGES)
    large = buckets.where("chunk > 0")
    if not large.isEmpty():
        # Large buckets with one least node are one group.
        named = large.groupBy("bucket").agg(F.min(F.array_min("members")).alias("part"))
        rows = large.join(named, "bucket").select("part", F.explode("members").alias("node")).distinct()
        rows = materialise(rows.join(nodes.select("node", "doc_id"), "node").select("part", "doc_id"), "large")
        own = nodes.select("doc_id", "n", "bits", F.lit(None).cast("binary").alias("set"))
        edges = edges.unionByName(_blocked_stars(rows, lambda dealt: dealt.join(own, "doc_id"), threshold, BUCKET_ROWS))
        discard(rows)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))


def _links(members: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Star edges (by doc_id) of the exact links within candidate groups.
    members: doc_id, part (the group)."""
    kept = ["doc_id", "part", "pivot", "blocks", "block"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = shingler.sets(b.column("text").to_pylist())
                told = [pa.array([len(s) for s in sets], pa.int64()), pa.nulls(b.num_rows, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *told], names=[*kept, "n", "bits", "set"])

    def load(dealt: DataFrame) -> DataFrame:
        told = _texts(docs).join(dealt.hint("shuffle_hash"), "doc_id").select(*kept, "text")
        return told.mapInArrow(sets_of, ", ".join(f"{c} long" for c in kept) + ", n long, bits binary, set binary")

    return _blocked_stars(members, load, threshold, BLOCK_ROWS)


def join(docs: DataFrame, width: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    parts = _parts(_texts(docs))
    described = materialise(describe(docs, width, threshold, parts), "described")
    rows = materialise(described.where("part is null").select("doc_id", "n", "node"), "rows")
    nodes = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.max("bits").alias("bits"))
    nodes = materialise(nodes.where("doc_id is not null"), "nodes")
    buckets = materialise(_buckets(described, parts), "buckets")
    discard(described)
    release(docs.sparkSession)
    members = materialise(_candidates(buckets, nodes, threshold), "members")
    discard(buckets)
    links = _links(members, docs, width, threshold)
    reached = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    classes = nodes.select("node", "doc_id").join(reached, "doc_id", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    found = rows.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    found = materialise(found, "joined")
    for x in (rows, nodes, members):
        discard(x)
    release(docs.sparkSession)
    return found


def keep_one(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs``, as they are, one of each component: that of the
    smallest doc_id; of rows that share it, the one with the least hash of text.
    Rows without a doc_id belong to no component and stay."""
    first = join(docs, width, threshold).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    kept = docs.join(first, F.col("doc_id") == F.col("_first"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return kept.withColumn("_nth", nth).where("_nth = 1").drop("_nth").unionByName(docs.where("doc_id is null"))


ORACLE_SQL = r"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])) end) as g from w),
n as (select doc_id, count(*) as c from s group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select u, v from shared join n a on a.doc_id = u join n b on b.doc_id = v where 100 * shared.c >= 90 * (a.c + b.c - shared.c)),
r as (select doc_id, doc_id as o from documents union select r.doc_id, e.v from r join e on e.u = r.o)
select doc_id, coalesce(any_value(n.c), 0) as n_shingles, min(o) as component_id from r left join n using (doc_id) group by doc_id"""
