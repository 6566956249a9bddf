import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annalist.llm import packing, pieces

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
MODEL = pieces.PieceModel(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOKENIZER = Tokenizer.from_file(WORDS)
ODD = ["", " ", "   ", "abab" * 40, "a" * 5000, " " * 3000 + "x", "▁▁ x▁", "\0\n\t", "é́ 漢字 😀 𐍈", "the the  the", "x" * 70 + " " * 70, "İIſK Σας"]
texts = st.text(st.sampled_from(list("abeinorst  \n.▁é漢0'")) | st.characters(exclude_categories=["Cs"]), max_size=200)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_library(text):
    ids = MODEL.encode_batch([text])[0].tolist()
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_odd_pieces_and_any_ids():
    assert [x.tolist() for x in MODEL.encode_batch(ODD)] == LIBRARY.encode(ODD)
    rnd = random.Random(2)
    for _ in range(500):
        ids = [rnd.randrange(0, 300) if rnd.random() < 0.5 else rnd.randrange(32000) for _ in range(rnd.randrange(12))]
        assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "hello world", 2), (3, "hello world", 2)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.n_tokens for r in pieces.digest(df, PIECES).collect()}
    assert got == {1: 1, 2: 1, 3: 1 + len(LIBRARY.encode("hello world"))}
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df, PIECES), PIECES).collect()}
    assert back == {1: "", 2: "", 3: "hello world"}
    assert pieces.digest(df.where("false"), PIECES).count() == 0


@given(texts)
@settings(max_examples=300, deadline=None)
def test_chunk_tokens_equal_whole_text(text):
    got = np.frombuffer(packing._tokenizer(WORDS).ids([text])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_odd_chunks():
    for t in [*ODD, "don't I'M x'sand 'sand", "a\x1cb\x85c d", "<|endoftext|>x", "Ünïcode,naïvẽ ﬁ Ⅷ²"]:
        assert np.frombuffer(packing._tokenizer(WORDS).ids([t])[0], "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_special_tokens_match_in_exact_case():
    texts = ["One <|ENDOFTEXT|> Two", "x<|EndOfText|>", "A <|endoftext|> <|STARTOFTEXT|> B"]
    got = packing._ChunkTokenizer(WORDS).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def ffd(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        for k, r in enumerate(rooms):
            if r >= x:
                rooms[k] -= x
                break
        else:
            rooms.append(capacity - x)
    return len(rooms)


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=200, deadline=None)
def test_plan_holds_every_length_and_is_about_as_good_as_first_fit(lengths):
    plan = packing.plan(Counter(lengths), 64)
    held = Counter()
    for p in plan:
        assert sum(x * n for x, n in p.lengths) <= 64 and p.repeats > 0
        for x, n in p.lengths:
            held[x] += n * p.repeats
    assert held == Counter(lengths)
    assert sum(p.repeats for p in plan) <= ffd(lengths, 64) + 1 + len(lengths) // 40
    rest = packing.pack_rest(Counter(lengths), 64)
    assert sum(p.repeats for p in rest) == ffd(lengths, 64)


def test_plan_fills_sequences_on_many_documents():
    rnd = random.Random(5)
    histogram = Counter(min(4096, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(20_000))
    total = sum(k * n for k, n in histogram.items())
    assert sum(p.repeats for p in packing.plan(histogram)) <= 1.002 * total / 4096 + 1


def check_packed(rows, docs, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for i, t in docs:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    docs = [(k, "one two " * (k % 9)) for k in range(60)] + [(100 + k, "same") for k in range(80)] + [(1, None), (1, None), (2, "long " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_packed(packing.pack_documents(df, WORDS, 64).collect(), docs, 64)
    assert packing.pack_documents(df.where("false"), WORDS, 64).count() == 0
    ids = packing.pack_documents(df.where("doc_id = 2"), WORDS, 64, with_ids=True).orderBy("start").collect()
    assert [len(r.ids) for r in ids] == [r.length for r in ids]
