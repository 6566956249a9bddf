import base64
import hashlib
import json
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import secrets

DER = bytes.fromhex("3039") + b"\x02\x01\x01" + b"\x04\x20" + bytes(range(32)) + b"\xa0\x12" + b"\x06\x05\x2b\x81\x04\x00\x0a" + b"\x04\x09" + b"k" * 9
KINDS = {
    "assign": (re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def brute(text):
    out = [(m.start(), list(KINDS).index(k), k, m.end()) for k, (rx, g, n) in KINDS.items() for m in rx.finditer(text or "") if len(m[g]) >= n]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def b64(data):
    return base64.b64encode(data).decode()


def jwt(head, body, sig=b"s" * 32):
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    return ".".join([part(json.dumps(head).encode()), part(json.dumps(body).encode()), part(sig)])


pieces = st.sampled_from([*"tokenTOKENsecretpwd=: \"'0123456789abcdefAKIAXſK_", "token=", "AKIA", "password: '", "apikey=", 'secret"=', "0123456789abcdef"])


@given(st.lists(pieces, max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans_equal_brute_force(text):
    assert [x for x in secrets.find_spans(text) if x[0] in secrets.BASE_KINDS] == brute(text)


def test_structures_are_confirmed():
    assert secrets.is_der_key(DER)
    assert not secrets.is_der_key(DER + b"\0") and not secrets.is_der_key(DER[:-1])
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(b"n" * 64)
    assert secrets.is_ssh_key(ssh) and not secrets.is_ssh_key(ssh + b"x")
    kinds = lambda t: {k for k, _, _ in secrets.find_spans(t)} - set(secrets.BASE_KINDS)
    assert kinds("key " + b64(DER) + " end") == {"der"}
    assert kinds("key " + DER.hex().upper()) == {"der"}
    assert kinds(b64(ssh)) == {"ssh"}
    assert kinds(b64(b"just a long and harmless sentence of text, no key")) == set()
    assert kinds(jwt({"alg": "HS256"}, {"sub": "1"})) == {"jwt"}
    assert kinds(jwt({"typ": "x"}, {"sub": "1"})) == set() and kinds(jwt({"alg": "none"}, {})) == set()
    pem = f"-----BEGIN EC PRIVATE KEY-----\n{b64(DER)[:40]}\n{b64(DER)[40:]}\n-----END EC PRIVATE KEY-----"
    assert "pem" in kinds(pem)
    assert "pem" not in kinds(pem.replace(b64(DER)[:40], "A" * 40))


def test_redaction_covers_overlaps_and_leaves_the_rest():
    text = 'a token = "' + "ab" * 20 + '" z é AKIA' + "Q" * 12 + "."
    assert secrets.redact(text, secrets.find_spans(text)) == 'a [secret]" z é [secret].'
    assert secrets.redact("plain", []) == "plain" and secrets.redact(None, []) is None


def test_rows(spark):
    long = "x " * 200_000 + "password=abcdefgh1"
    rows = [(1, None, "a"), (2, "", "a"), (3, "secret: 12345678", "a"), (3, "secret: 12345678", "a"), (4, long, "b"), (None, "token=short", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")  # a clashing name
    got = secrets.digest(df).collect()
    assert len(got) == 6
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] or 0)), strict=True):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        assert (r.doc_id, r.base_sha256, r.spans) == (i, hashlib.sha256(want.encode()).hexdigest(), want)
    assert secrets.digest(df.where("false")).count() == 0
    docs = spark.createDataFrame([(1, "secret: 12345678", 16)], "doc_id long, text string, n_chars long")
    assert secrets.redact_documents(docs).collect()[0][1:] == ("[secret]", 8)
    assert secrets.scan(df).where("size(spans) = 1").count() == 3


def test_keys_at_any_place_of_a_run():
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(b"n" * 64)
    keys = 70
    opened = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + keys.to_bytes(4, "big") + field(ssh) * keys + field(b"p" * 32)
    assert secrets.is_ssh_key(opened) and not secrets.is_ssh_key(opened[:-1]) and not secrets.is_ssh_key(opened + field(b"x"))
    added = lambda t: [x for x in secrets.find_spans(t) if x[0] not in secrets.BASE_KINDS]
    for before in range(6):
        for kind, key in (("der", DER), ("ssh", ssh), ("ssh", opened)):
            run = b64(key)
            assert added(": " + "/" * before + run) == [(kind, 2 + before, 2 + before + len(run))]
    assert added(": " + ssh.hex()) == [("ssh", 2, 2 + 2 * len(ssh))]
    assert added(": 00ff" + DER.hex()) == [("der", 6, 6 + 2 * len(DER))]


def test_long_texts_take_linear_time():
    field = (4).to_bytes(4, "big") + b"ssh-"
    texts = ["-----BEGIN A KEY-----" * 240_000, "-----BEGIN A KEY----------END B KEY-----" * 120_000, "eyJ" + "a" * 5_000_000, ("token" + " " * 20) * 200_000, "M" * 5_000_000, b64(field * 470_000), b64(b"\x02\x04\x30\x82\xff\xff" * 600_000), "30" * 2_500_000, "." * 5_000_000]
    for t in texts:
        start = time.process_time()
        secrets.find_spans(t)
        assert time.process_time() - start < 60
