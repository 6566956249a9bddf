"""Language identification, word first with backoff.

A known word scores its log frequency in each language. An unseen word falls
back to its longest character n-grams that are known, from five letters down to
one. A document's evidence is the mean over all its words, sharpened with the
number of words up to a bound, and the score is the posterior of the winner.

Counts come from a bounded sample of labelled rows outside the held-out ones, at
most ``MAX_PER_LANGUAGE`` documents of each language (whole texts, counted by
Spark). Every word of the sample is in the model, and n-gram counts follow from
all of them; the bound on documents is a parameter and the only one. The model is flat
arrays: words and n-grams in the order of 64-bit hashes, n-grams known by the
hash alone.

Defined cases: a text that is null or has no letter is ``und`` with score 0.0;
ties go to the language first in the alphabet; with no labelled rows everything
is ``und``; repeated rows each get a result; an empty table gives an empty
result; texts and runs of any length are read whole, in linear time; columns but
doc_id and text are not read for a prediction, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Fitted, fit_in_task, held_out, mix64

MAX_PER_LANGUAGE = 4000
LONGEST, SHARPEST = 5, 24
CACHE_WORDS = 120_000
#: Words and places of their letters that are looked at together.
WORDS_AT_ONCE, PLACES_AT_ONCE = 1 << 16, 1 << 18

_WORD = re.compile(r"[^\W\d_]+")


def _letters(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each within its marks, and where each word ends."""
    words = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))


def _mixed(codes: np.ndarray, places: np.ndarray | int) -> np.ndarray:
    return mix64(codes.astype(np.uint64) << np.uint64(32) | np.asarray(places + 1).astype(np.uint64))


def _blocks(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of letters and the words that they lie in, a block at a time."""
    for start in range(0, int(ends[-1]) if len(ends) else 0, PLACES_AT_ONCE):
        at = np.arange(start, min(start + PLACES_AT_ONCE, int(ends[-1])))
        yield at, np.searchsorted(ends, at, side="right")


def _word_hashes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts, out = np.concatenate([[0], ends[:-1]]), np.zeros(len(ends), np.uint64)
    for at, of in _blocks(ends):
        np.add.at(out, of, _mixed(codes[at], at - starts[of]))
    return out


def _gram_hashes(codes: np.ndarray, ends: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams and the words that they lie in, a block at a time."""
    for at, of in _blocks(ends):
        whole = ends[of] - at >= n
        at, of = at[whole], of[whole]
        yield sum((_mixed(codes[at + j], j) for j in range(n)), np.zeros(len(at), np.uint64)), of


class Known:
    """Per-language log frequencies in the order of 64-bit hashes. Words keep their
    names, which are compared; n-grams are known by hash."""

    def __init__(self, hashes: np.ndarray, logs: np.ndarray, names: pa.Array | None = None) -> None:
        self.hashes, self.logs, self.names = hashes, logs, names

    def __len__(self) -> int:
        return len(self.hashes)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names.to_pylist())

    def __contains__(self, gram: str) -> bool:
        return bool(self.find(_mixed(np.array([ord(c) for c in gram]), np.arange(len(gram))).sum(keepdims=True))[1][0])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes``, and which are there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


class Model:
    """Per-language log frequencies of words and character n-grams."""

    def __init__(self, languages: list[str], words: Known, grams: list[Known]) -> None:
        self.languages, self.words, self.grams = languages, words, grams
        self._seen: dict[str, int] = {}
        self._table = np.zeros((1024, len(languages)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__init__(*(state[k] for k in ("languages", "words", "grams")))

    def backoff(self, word: str) -> np.ndarray:
        """The mean over the longest known n-grams of an unseen word."""
        return self._backoff([word])[0]

    def _backoff(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            known, (codes, ends) = self.grams[n - 1], _letters(words[i] for i in left)
            hits, sums = np.zeros(len(left), np.int64), np.zeros((len(left), len(self.languages)))
            for hashes, of in _gram_hashes(codes, ends, n):
                at, there = known.find(hashes)
                at, of = at[there], of[there]
                hits += np.bincount(of, minlength=len(left))
                for k in range(len(self.languages)):
                    sums[:, k] += np.bincount(of, known.logs[at, k], len(left))
            some = hits > 0
            out[left[some]] = sums[some] / hits[some, None]
            left = left[~some]
        return out

    def _look(self, words: list[str]) -> np.ndarray:
        """Log frequencies of ``words``, known or not."""
        at, there = self.words.find(_word_hashes(*_letters(words)))
        there = np.flatnonzero(there)
        there = there[[x == words[i] for x, i in zip(self.words.names.take(pa.array(at[there])).to_pylist(), there.tolist(), strict=True)]] if len(there) else there
        out = np.zeros((len(words), len(self.languages)))
        out[there] = self.words.logs[at[there]]
        unseen = np.setdiff1d(np.arange(len(words)), there, assume_unique=True)
        out[unseen] = self._backoff([words[i] for i in unseen.tolist()])
        return out

    def _index(self, words: list[list[str]]) -> dict[str, int]:
        """Row of each word in ``_table``."""
        every = set().union(*words)
        new = list(every.difference(self._seen))
        if len(self._seen) + len(new) > CACHE_WORDS:
            self._seen, self._table, new = {}, np.zeros((1024, len(self.languages)), np.float32), list(every)
        base = len(self._seen)
        if base + len(new) > len(self._table):
            grown = np.zeros((max(2 * len(self._table), base + len(new)), len(self.languages)), np.float32)
            grown[:base] = self._table[:base]
            self._table = grown
        for k in range(0, len(new), WORDS_AT_ONCE):
            some = new[k : k + WORDS_AT_ONCE]
            self._table[base + k : base + k + len(some)] = self._look(some)
        self._seen.update(zip(new, range(base, base + len(new)), strict=True))
        return self._seen

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        words = [ws if any(map(str.isalpha, ws)) or any(map(str.isalpha, chain.from_iterable(ws))) else [] for ws in words]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = [i for i, ws in enumerate(words) if ws] if self.languages else []
        if not told:
            return langs, scores
        row = self._index([words[i] for i in told]).__getitem__
        sizes = np.array([len(words[i]) for i in told])
        at = np.fromiter(map(row, chain.from_iterable(words[i] for i in told)), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(self._table[at], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
        logit = sums / sizes[:, None] * np.minimum(sizes, SHARPEST)[:, None]
        p = np.exp(logit - logit.max(1, keepdims=True))
        best = p.argmax(1)
        for i, k, score in zip(told, best.tolist(), (p.max(1) / p.sum(1)).tolist(), strict=True):
            langs[i], scores[i] = self.languages[k], score
        return langs, scores


def _logs(counts: np.ndarray, by: float) -> np.ndarray:
    return np.log((counts + by) / (counts.sum(0) + by * len(counts))).astype(np.float32)


def _summed(hashes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sums of their rows."""
    found, at = np.unique(hashes, return_inverse=True)
    return found, np.array([np.bincount(at, w, len(found)) for w in sums.T]).reshape(sums.shape[1], len(found)).T


def train(languages: Sequence[str], counted: Iterable[tuple[str, str, int]]) -> Model:
    """From (lang, word, n) rows."""
    rows = list(counted)
    columns = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64())))
    return train_columns(languages, pa.table(list(columns), names=["lang", "word", "count"]))


def train_columns(languages: Sequence[str], counted: pa.Table) -> Model:
    """From a table of lang, word, count."""
    languages = sorted(languages)
    lang, word = (counted.column(c).combine_chunks().dictionary_encode() for c in ("lang", "word"))
    column = np.searchsorted(languages, lang.dictionary.to_pylist()) if len(lang) else np.zeros(0, np.int64)
    names, of = word.dictionary, word.indices.to_numpy()
    places = of * len(languages) + column[lang.indices.to_numpy()]
    counts = np.bincount(places, counted.column("count").to_numpy(), len(names) * len(languages)).reshape(len(names), len(languages))
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(LONGEST)]
    hashes = [np.zeros(0, np.uint64)]
    for start in range(0, len(names), WORDS_AT_ONCE):
        codes, ends = _letters(names.slice(start, WORDS_AT_ONCE).to_pylist())
        hashes.append(_word_hashes(codes, ends))
        weights = np.log1p(counts[start : start + WORDS_AT_ONCE])
        for n, part in enumerate(parts, 1):
            part += [_summed(some, weights[whose]) for some, whose in _gram_hashes(codes, ends, n)]
    order = np.argsort(np.concatenate(hashes), kind="stable")
    words = Known(np.concatenate(hashes)[order], _logs(counts, 0.5)[order], names.take(pa.array(order)))
    grams = []
    for part in parts:
        found, sums = _summed(np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in part)]), np.concatenate([np.zeros((0, len(languages))), *(x for _, x in part)]))
        part.clear()
        grams.append(Known(found, _logs(sums, 0.5)))
    return Model(languages, words, grams)


def fit(docs: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Fitted:
    """Count the words of the sampled labelled rows in Spark; one task makes the
    :class:`Model` of the sample's (language, word, count) rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Fitted(pickle.dumps(train([], [])))
    part = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(1_000_000 * min(1.0, max_per_language / n)))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part[F.col("lang")])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    languages = list(sizes)

    def made(batches: list[pa.RecordBatch]) -> Model:
        return train_columns(languages, pa.Table.from_batches(batches)) if batches else train(languages, [])

    return fit_in_task(words.groupBy("lang", "word").count().select("lang", "word", "count"), made)


def identify(docs: DataFrame, model: Fitted, keep: Sequence[str] = ()) -> DataFrame:
    """_id, _lang, _score of each row, and the columns named in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *(F.col(f"`{f.name}`") for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.model
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                langs, scores = m.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *b.columns[2:]], names=["_id", "_lang", "_score", *b.schema.names[2:]])

    return rows.mapInArrow(run, ", ".join(["_id long", "_lang string", "_score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)]))


def keep_known(docs: DataFrame, model: Fitted, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, in a learned language with a score of
    ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                langs, scores = shared.value.model.predict(b.column(at).to_pylist())
                yield b.filter(pa.array([x != "und" and y >= least for x, y in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame) -> DataFrame:
    """The query contract: doc_id, held_out, lang_pred, score."""
    found = identify(docs, fit(docs))
    return found.select(F.col("_id").alias("doc_id"), held_out(F.col("_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
