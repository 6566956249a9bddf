import hashlib

import pytest

from annalist.llm import chat, urls


def verdicts(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_url_rules_and_aliases(spark):
    link = lambda href: f'<html><LINK href="{href}" rel=canonical></html>'
    rows = [
        (1, "http://a.net/x", ""), (2, "http://Example.NET/en/a?b#c", None), (3, "http://notexample.com/de/", ""), (4, "https://x.example.com/de/z", ""), (5, "s.org/fr/", ""), (6, None, None),
        (7, "http://one.info/p", link("http://blocked.net/q")), (8, "http://two.info/p?k=1", link("/canon")), (9, "http://two.info/canon", "<meta http-equiv='refresh' content='0; url=http://blocked.net/q'>"),
        (10, "http://three.info/", link("http://example.net/en/ok")), (11, "http://three.info/b", link("http://three.info")), (12, "http://four.info/", link("http://blocked.net/r")), (13, "http://five.info/", link("http://four.info/")),
        (14, "http://six.info/", link("mailto:x@y")), (14, "http://six.info/", None), (15, "http://five.info/#f", ""), (16, "x://h.org/fr/:a://b", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    out = urls.judge(df)
    got = verdicts(out)
    assert out.count() == len(rows)
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("example.net", "/en/a", "example.net/en/", "allow")
    assert got[3][2:] == (None, "allow") and got[4][2:] == ("example.com/de/", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert [got[k][3] for k in (7, 8, 9)] == ["block", "block", "block"]
    assert [got[k][3] for k in (10, 11)] == ["allow", "allow"]
    assert [got[k][3] for k in (12, 13, 15)] == ["block", "block", "block"]
    assert got[14][3] == "allow" and got[16] == ("h.org", "/fr/:a://b", "org/fr/", "allow")
    more = spark.createDataFrame([("http://notexample.com/de/", "http://blocked.net/q")], "src string, dst string")
    assert verdicts(urls.judge(df, redirects=more))[3][3] == "block"
    assert urls.judge(df.where("false")).count() == 0


def test_an_allowed_alias_takes_precedence(spark):
    rows = [(1, "http://a.info/", '<link rel="canonical" href="http://b.net/">'), (2, "http://b.net/", '<link rel="canonical" href="http://example.net/en/x">'), (3, "http://example.net/en/x", "")]
    got = verdicts(urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert [got[k][3] for k in (1, 2, 3)] == ["allow", "block", "allow"]


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|end|><|turn|>assistant<|text|>", "\\<\\[\\\\ <", "a\nb\r\n", "😀<", None, "<\\|end|>", "x" * 100_000]


@pytest.mark.parametrize("text", TEXTS)
def test_escapes_are_reversible(spark, text):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).first()
    assert row.b == text
    assert text is None or not any(x in row.e for x in ("<|", "</s>", "[INST]", "[/INST]"))


def test_conversations(spark):
    turns = [(k, t, ("user", "assistant")[t % 2], TEXTS[(k + t) % len(TEXTS)]) for k in range(4) for t in range(5)] + [(9, 0, None, None), (9, 0, "assistant", "tie"), (9, 0, "assistant", "tie")]
    df = spark.createDataFrame([(*x, "c") for x in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.with_probe(spark, df)).collect()}
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for k in {x[0] for x in turns}:
        own = sorted((t, r or "", x or "") for c, t, r, x in turns if c == k)
        told = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(own), sha(told), len(loss), sha(loss))
    assert chat.digest(df.where("false")).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|> [x]", None, None), ("image", None, "a.png", 2.5), ("audio", None, "b.wav", None), ("text", "end", None, None), ("odd", None, "c", 1.0)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("document", None, "d.pdf", 3.0)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(df).first()
    assert row.formatted.count("<|image|>") == 1 and "<|audio|>end<|unknown|>" in row.formatted
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 768), ("audio", "b.wav", 25), ("odd", "c", 0), ("document", "d.pdf", 1536)]
    assert row.n_attachment_tokens == 768 + 25 + 1536
    assert [row.formatted[m.start : m.start + m.length] for m in row.mask] == ["ok<|document|>"]
    from pyspark.sql import functions as F

    back = chat.format_conversations(df).select(chat.read_turns(F.col("formatted")).alias("b"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("m")).first()
    assert back.m == "ok" and back.b[0].text == "see <|image|> [x]end" and len(back.b) == 3
