import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.llm import caps, forest, shingles
from annalist.operators.graph import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reach(n_or_ids, links):
    up = {i: i for i in n_or_ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def word_sets(docs, width):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def brute_links(sets, threshold):
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if n >= threshold * (len(s) + len(sets[j]) - n):
                yield i, j


def corpus(seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(300)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "Two words"), (4, "two WORDS"), (5, "İ two words"), (6, " ".join(base)), (7, " ".join(base).upper().replace("W", "w")), (8, "a\x1cb c d"), (9, "x " * 30_000)]
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randrange(1, 12)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        docs.append((100 + k, " ".join(w)))
    docs += [(200 + k, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 16)))) for k in range(150)]
    docs += [(400 + k, " ".join(f"q{j}" for j in range(k, k + 60))) for k in range(30)]  # a chain
    docs += [(500 + k, " ".join(f"r{j}" for j in range(k // 3 * 7, k // 3 * 7 + 25))) for k in range(30)]
    return docs


@pytest.mark.parametrize("width, threshold, block", [(3, Fraction(9, 10), 512), (3, Fraction(9, 10), 12), (5, Fraction(4, 5), 12)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, width, threshold, block):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", block)
    monkeypatch.setattr(shingles, "BUCKET_ROWS", block)
    monkeypatch.setattr(shingles, "HELD_ROWS", 40 * block)
    docs = corpus(block)
    sets = word_sets(docs, width)
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, node long")  # a clashing name
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingles.join(df, width, threshold).collect()}
    want = reach(sets, brute_links(sets, threshold))
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_signatures_meet_for_every_linking_pair():
    rng = np.random.default_rng(3)
    for threshold in (Fraction(9, 10), Fraction(4, 5)):
        bands = shingles.Bands(threshold)
        for _ in range(1500):
            n = int(rng.integers(1, 400))
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            differ = int(rng.integers(0, n // 4 + 1))
            more = int(rng.integers(0, differ + 1))
            b = np.concatenate([a[differ - more :], rng.integers(0, 2**63, more, dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if len(b) and common >= threshold * (len(a) + len(b) - common):
                assert len(np.intersect1d(bands.signatures(np.unique(a)), bands.signatures(np.unique(b))))


def test_join_of_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in shingles.join(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert shingles.join(df.where("false")).count() == 0
    kept = shingles.keep_one(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1]


def test_components_equal_brute_force(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, k) for k in range(2000, 2100)]
    want = reach({x for e in links for x in e}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (7, 7), (None, 3)], "u long, v long")).collect()}
    assert got == {i: c for i, c in want.items() if sum(x == c for x in want.values()) > 1}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(n, seed, dim=64):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.standard_normal((n, dim)))
    near = [unit(x[k] + eps * rng.standard_normal((m, dim))) for k, m, eps in ((0, 80, 0.02), (1, 60, 0.028), (2, 40, 0.01))]
    return np.concatenate([x, *near, np.repeat(x[3:4], 50, 0)]).astype(np.float32)


def frame(spark, e):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(e)]
    n = len(e)
    odd = [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [None] * 64), (n + 4, [1.0, 2.0]), (n + 5, []), (n + 6, [float("inf")] + [0.0] * 63)]
    return spark.createDataFrame(rows + [(i, v, 0) for i, v in odd], "vec_id long, embedding array<float>, a int")


@pytest.mark.parametrize("block", [16, 1024])
def test_caps_find_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK_ROWS", block)
    e = vectors(400, block)
    got = {r.vec_id: r for r in caps.link(frame(spark, e)).collect()}
    x = e.astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    want = reach(range(len(e)), zip(*np.nonzero(hit), strict=True))
    assert [got[k].n_links for k in range(len(e))] == hit.sum(1).tolist()
    assert {k: got[k].component_id for k in range(len(e))} == want
    assert all(got[k].kept == (want[k] == k) for k in range(len(e)))
    assert all(got[len(e) + k].n_links == 0 and got[len(e) + k].kept for k in range(7))
    assert caps.link(frame(spark, e).where("false")).count() == 0


def test_caps_miss_nearly_no_pair_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1)[:, None]
    z, words = caps.parameters(50_000, 0.95)
    missed = sum(not len(np.intersect1d(a, b)) for a, b in zip(caps.filters(x, z, words), caps.filters(y, z, words), strict=True))
    assert missed <= 5


def recall(x, ids, rows, k=10):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.score, r.vec_id))
    place = {i: n for n, i in enumerate(ids)}
    found = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[place[q]]) ** 2).sum(1))
        d[place[q]] = np.inf
        best = np.lexsort((ids, d))[:k]
        assert len(near) == k and near == sorted(near) and q not in {i for _, i in near}
        assert all(abs(s - d[place[i]]) < 1e-12 for s, i in near)
        found += len({i for _, i in near} & {ids[n] for n in best})
    return found / k / len(got), set(got)


def test_forest_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(forest, "SLOT_ROWS", 25)
    e = vectors(900, 2)
    share, asked = recall(e.astype(float), list(range(len(e))), forest.search(frame(spark, e), F.col("vec_id") % 20 == 0).collect())
    assert asked == set(range(0, len(e), 20)) and share >= 0.9


def test_forest_recall_at_the_defaults(spark):
    folder = "/root/testdata/sf0.1"
    if os.path.isdir(folder):
        given = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
        rows = sorted((r.vec_id, r.embedding) for r in given.collect())
        share, _ = recall(np.array([v for _, v in rows], float), [i for i, _ in rows], forest.search(given, F.col("vec_id") % 100 == 0).collect())
        assert share >= 0.9
    e = np.random.default_rng(8).standard_normal((30_000, 64)).astype(np.float32)
    e /= np.linalg.norm(e, axis=1)[:, None]
    many = spark.createDataFrame(pa.table({"vec_id": np.arange(len(e)), "embedding": pa.array(list(e), pa.list_(pa.float32()))}))
    share, _ = recall(e.astype(float), list(range(len(e))), forest.search(many, F.col("vec_id") % 1000 == 0).collect())
    assert share >= 0.9


def test_forest_with_few_candidates(spark):
    df = frame(spark, vectors(4, 1)[:1])
    assert forest.search(df, F.col("vec_id") >= 0).count() == 0
    assert forest.search(df.where("false"), F.col("vec_id") >= 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in forest.search(three, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 200), (100, 1, 0), (100, 2, 200), (200, 1, 0), (200, 2, 100)]
