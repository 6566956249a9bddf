import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import language, quality

WORDS = {"en": "the of and to in is was that house water green walking", "de": "der die und das ist nicht haus wasser grün gehen über straße", "fr": "le la les et est dans maison eau vert marcher être où"}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        words = [rnd.choice(WORDS[lang].split()) for _ in range(rnd.randrange(5, 60))]
        good = k % 4 != 1
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), lang, "s", 0, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, good int")


def test_languages(spark, docs):
    odd = spark.createDataFrame([(900, None, None), (901, "", "en"), (902, "123 !?", None), (903, "waterhouse greenwalk", None), (903, "waterhouse greenwalk", None), (904, "und " * 100_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text", "lang").unionByName(odd).withColumns({"score": F.lit(9), "lang_pred": F.lit("x"), "_lang": F.lit("y")})).collect()}
    held = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) == len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[904].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.predict(docs.select("doc_id", "text", "lang").where("false"))
    assert nothing.count() == 0
    unlabelled = docs.select("doc_id", "text").selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.predict(unlabelled).collect()} == {"und"}


def test_backoff_uses_the_longest_known_grams():
    model = language.train(["a", "b"], [("a", "xyzzy", 9), ("b", "plugh", 9)])
    assert model.predict(["xyzz", "plu", "qqq"])[0][:2] == ["a", "b"]
    assert model.backoff("xyzzq")[0] > model.backoff("xyzzq")[1]


def test_backoff_reads_the_whole_run():
    model = language.train(["a", "b"], [("a", "xyzzy", 9), ("b", "plugh", 9)])
    assert model.predict(["xyzzy" * 13 + "plugh" * 100])[0] == ["b"]


def test_blocks_and_a_full_cache_change_nothing(monkeypatch):
    rnd = random.Random(4)
    rows = [(x, "".join(rnd.choices(letters, k=rnd.randrange(1, 9))), rnd.randrange(1, 5)) for x, letters in (("a", "abcdé"), ("b", "defgß文")) for _ in range(300)]
    texts = [" ".join("".join(rnd.choices("abcdefgzéß文", k=rnd.randrange(1, 40))) for _ in range(30)) for _ in range(20)]
    whole = language.train(["a", "b"], rows).predict(texts)
    for name, value in (("PLACES_AT_ONCE", 7), ("WORDS_AT_ONCE", 5), ("CACHE_WORDS", 10)):
        monkeypatch.setattr(language, name, value)
    model = language.train(["a", "b"], rows)
    cut = [model.predict([t]) for t in texts]
    assert [x[0][0] for x in cut] == whole[0]
    assert np.allclose([x[1][0] for x in cut], whole[1], atol=1e-6)


def test_a_letter_beside_a_numeral_is_a_letter():
    model = language.train(["a", "b"], [("a", "xyzzy", 9), ("b", "plugh", 9)])
    assert model.predict(["x²", "²", "½ 7"])[0] == ["a", "und", "und"]


def test_every_word_of_the_sample_is_in_the_model(spark):
    common = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(100_001)]
    rows = [(0, " ".join(common * 2), "a"), (1, "zqxjw zqxjv", "b")]
    assert not any(zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in rows)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).model
    assert len(model.words) == 100_003 and {"zqxjw", "zqxjv"} <= set(model.words)
    assert model.predict(["zqxjw", "zqxjk", "abcabc"])[0] == ["b", "b", "a"]
    assert "zqxj" in model.grams[3]


def test_quality(spark, docs):
    labels = docs.selectExpr("doc_id", "good as quality", "0 as toxic")
    labels = labels.unionByName(labels.where("doc_id < 10")).unionByName(spark.createDataFrame([(5, None, 0)], "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "the of " * 50_000), (903, "AND!! OF!!"), (903, "AND!! OF!!")], "doc_id long, text string")
    rows = quality.classify(docs.select("doc_id", "text").unionByName(odd).withColumns({"score": F.lit(9), "label": F.lit(1), "_score": F.lit(2)}), labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 245
    held = [(got[r.doc_id].predicted, r.good) for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score == 0.0 and got[903].predicted == 0
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs.select("doc_id", "text"), labels.where("false")).collect()} == {0.0}
    assert quality.classify(docs.select("doc_id", "text").where("false"), labels.where("false")).count() == 0


def test_long_chunks_count_whole():
    same, features = "x" * 64, quality.Features()
    whole = [dict(zip(*map(list, features.counts(same + rest)), strict=True)) for rest in ("ab" * 80, "ba" * 79 + "cd", "A1" * 80)]
    assert all(a != b for a, b in zip(whole, whole[1:], strict=False))
    start = "文" * 80
    texts = [start + "".join(random.Random(k).choices("甲乙丙丁" if k % 2 else "子丑寅卯", k=200)) for k in range(60)]
    model = quality.train([features.counts(t) for t in texts[:40]], [k % 2 for k in range(40)])
    got = model.scores(np.array([model.vector(*features.counts(t)) for t in texts[40:]]))
    assert [int(x >= 0.7) for x in got] == [k % 2 for k in range(20)]


def test_shapes_are_read_whole():
    assert quality._shape("a-1-" * 4 + "?") != quality._shape("a-1-" * 4 + "!")


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((200, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    model = quality.Model(None, None, v[:150], rng.integers(0, 2, 150).astype(float))
    got = model.scores(v[150:])
    for x, s in zip(v[150:], got, strict=True):
        sims = np.maximum(model.vectors @ x, 0)
        near = np.argsort(-sims, kind="stable")[: quality.NEIGHBOURS]
        assert abs(s - (sims[near] * model.labels[near]).sum() / sims[near].sum()) < 1e-12


def test_backoff_scores_equal_brute_force():
    words = {"a": {"stone": 5, "stove": 2, "tone": 1}, "b": {"stern": 4, "torn": 3}}
    model = language.train(["b", "a"], [(x, w, n) for x, ws in words.items() for w, n in ws.items()])
    names = sorted({w for ws in words.values() for w in ws})

    def log(counts, known, lang):
        return np.log((counts(lang) + 0.5) / (sum(known(lang).values()) + 0.5 * size))

    for text in ("stone torn", "stole", "tornado stove zzz", "x stones STERN"):
        total = np.zeros(2)
        tokens = text.lower().split()
        for w in tokens:
            if w in names:
                size = len(names)
                total += [log(lambda x, w=w: words[x].get(w, 0), lambda x: words[x], x) for x in "ab"]
                continue
            for n in range(language.LONGEST, 0, -1):
                grams = {x: {} for x in "ab"}
                for x in "ab":
                    for v, k in words[x].items():
                        for i in range(len(v) + 3 - n):
                            g = f"^{v}$"[i : i + n]
                            grams[x][g] = grams[x].get(g, 0) + np.log1p(k)
                every = set(grams["a"]) | set(grams["b"])
                size = len(every)
                hit = [g for g in (f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)) if g in every]
                if hit:
                    total += np.mean([[log(lambda x, g=g: grams[x].get(g, 0), lambda x: grams[x], x) for x in "ab"] for g in hit], 0)
                    break
        p = np.exp(total / len(tokens) * min(len(tokens), language.SHARPEST))
        got = model.predict([text])
        assert got[0] == ["ab"[int(np.argmax(p))]] and abs(got[1][0] - p.max() / p.sum()) < 1e-5
