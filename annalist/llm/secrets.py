"""Secret scans with structural confirmation.

Three base patterns give spans as they are. On top of those, base64, base64url
and hex candidates are decoded, and a span is added only when the decoded bytes
parse as what they claim to be: ASN.1 keys whose nested lengths add up, SSH
blobs whose length-prefixed fields end exactly at the end, signed tokens whose
header and payload are JSON objects, or PEM blocks around such a key.

Defined cases: a null text counts as empty and has no spans; an empty text has
none either; repeated rows each get their own result; other columns of the
input are not read, so clashing names do no harm; an empty table gives an
empty result. Of the keys that end where a run does, the outermost is reported.
Work and memory per row are linear in the length of its text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "pem")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of [0-9a-f]+ that is long enough is exactly a maximal run of 32 or more.
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_-])")
_PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{3,40})-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\\-]*")
#: Where an ASN.1 SEQUENCE or an SSH blob may begin in decoded bytes.
_BLOB = re.compile(rb"(?=\x30[\x16-\x7f\x81-\x84]|\x00\x00\x00.(?:ssh-|ecdsa-sha2-|sk-)|openssh-key-v1\x00)", re.S)
#: How a SEQUENCE, an SSH length or its magic begin in base64.
_SIGNS64 = ("M", "AAAA", "b3BlbnNzaC1")
#: No level of a key that is looked at has more items.
_MOST_ITEMS = 16


def _decode64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[at:end] exactly, else None."""
    items: list[tuple[int, int, int]] = []
    while at < end:
        if at + 2 > end or len(items) == _MOST_ITEMS:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or data[at] == 0:
                return None
            at += n
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def is_der_key(data: bytes, at: int = 0) -> bool:
    """Whether the bytes from ``at`` are one ASN.1 SEQUENCE holding a key: PKCS#1,
    PKCS#8, SEC 1 or SubjectPublicKeyInfo, with every nested length consistent."""
    if len(data) - at < 24 or data[at] != 0x30:
        return False
    top = _der_items(data, at, len(data))
    if not top or len(top) != 1:
        return False
    items = _der_items(data, top[0][1], top[0][2])
    if not items:
        return False
    tags = [x[0] for x in items]
    if len(items) >= 2 and all(t == 0x02 for t in tags):
        return len(items) in (2, 6, 9) and max(e - s for _, s, e in items) >= 16  # RSA or DSA numbers
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8
        inner = _der_items(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[:2] == [0x02, 0x04]:  # SEC 1
        return data[items[0][1] : items[0][2]] == b"\x01" and items[1][2] - items[1][1] >= 16
    if tags == [0x30, 0x03]:  # SubjectPublicKeyInfo
        inner = _der_items(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06 and items[1][2] - items[1][1] >= 16
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        inner = _der_items(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06
    return False


def _fields_left(data: bytes, at: int, known: dict[int, int]) -> int:
    """How many length-prefixed fields lead from ``at`` to the very end; -1 if none
    do. ``known`` keeps the answers, so that all walks over ``data`` are one pass."""
    path = []
    while at not in known:
        path.append(at)
        if at == len(data):
            known[at] = 0
        elif at + 4 > len(data) or (after := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
            known[at] = -1
        else:
            at = after
    left = known[at]
    for k, x in enumerate(reversed(path)):
        known[x] = known[x] if k == 0 and x in known else (left := left + 1 if left >= 0 else -1)
    return known[path[0]] if path else left


def is_ssh_key(data: bytes, at: int = 0, known: dict[int, int] | None = None) -> bool:
    """Whether the bytes from ``at`` are an SSH key blob whose length-prefixed
    fields end at the end."""
    known = {} if known is None else known
    if data.startswith(b"openssh-key-v1\0", at):
        at += 15
        for _ in range(3):  # cipher, kdf name, kdf options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return False
        keys = int.from_bytes(data[at : at + 4], "big")
        return keys >= 1 and _fields_left(data, at + 4, known) == keys + 1  # public keys, then the private part
    if len(data) - at < 16 or data[at : at + 3] != b"\0\0\0":
        return False
    first = data[at + 4 : at + 4 + data[at + 3]]
    return bool(re.match(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+$", first)) and _fields_left(data, at, known) > 1


def _blobs(data: bytes, step: int) -> Iterator[tuple[int, str]]:
    """(place, kind) of the keys in ``data`` that reach its end, at multiples of ``step``."""
    known: dict[int, int] = {}
    for m in _BLOB.finditer(data):
        at = m.start()
        if at % step == 0:
            if data[at] == 0x30:
                if is_der_key(data, at):
                    yield at, "der"
            elif is_ssh_key(data, at, known):
                yield at, "ssh"


def _pem(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of armoured blocks: from the last BEGIN before an END of its name."""
    begin = None
    for m in _PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and (body := _PEM_BODY.match(text, begin.end(), m.start())) and body.end() == m.start():
                yield begin.start(), m.end(), body.group()
            begin = None


def _json_object(part: str) -> dict | None:
    data = _decode64(part)
    try:
        found = json.loads(data.decode("utf-8")) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _base(text: str) -> Iterator[tuple[int, int, str]]:
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield m.start(), m.end(), "access"
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), "hex"


def _confirmed(text: str) -> Iterator[tuple[int, int, str]]:
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head = _json_object(m[1])
            if head and isinstance(head.get("alg"), str) and head["alg"].lower() != "none" and _json_object(m[2]) is not None and len(_decode64(m[3]) or b"") >= 16:
                yield m.start(), m.end(), "jwt"
    if "-----BEGIN " in text:
        for start, end, body in _pem(text):
            if "KEY" in text[start : start + 60].split("-----")[1]:
                data = _decode64(re.sub(r"(?m)^[A-Za-z-]+:.*$|\\[nr]|\s", "", body))
                if data and (is_der_key(data) or is_ssh_key(data)):
                    yield start, end, "pem"
    for m in _BASE64.finditer(text):
        # Characters before a key may shift it, so each of the four phases is decoded
        # once; a key begins at a whole group of four characters, three bytes.
        body = m.group().rstrip("=")
        if not any(x in body for x in _SIGNS64):
            continue
        for phase in range(min(4, len(body))):
            if (data := _decode64(body[phase:])) is not None:
                for at, kind in _blobs(data, 3):
                    yield m.start() + phase + at // 3 * 4, m.end(), kind
                    break
    for m in _HEX_ANY.finditer(text):
        run = m.group()
        if len(run) % 2 == 0 and any(x in run.lower() for x in ("30", "000000", "6f70656e")):
            for at, kind in _blobs(bytes.fromhex(run), 1):
                yield m.start() + 2 * at, m.end(), kind
                break


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then kind."""
    if not text:
        return []
    found = {*_base(text), *_confirmed(text)}
    return [(k, s, e) for s, e, k in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by ``[secret]``."""
    if not spans or text is None:
        return text
    out, kept_to, covered_to = [], 0, -1
    for start, end in sorted((s, e) for _, s, e in spans):
        if start >= covered_to:
            out += [text[max(kept_to, 0) : start], "[secret]"]
        covered_to = kept_to = max(covered_to, end)
    return "".join(out) + text[kept_to:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind,start,end>> for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_spans_of, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        old = b.column(at).to_pylist()
        new = [redact(t, find_spans(t)) for t in old]
        b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
        if (n := b.schema.get_field_index("n_chars")) >= 0:
            sizes = [len(y) if x != y else z for x, y, z in zip(old, new, b.column(n).to_pylist(), strict=True)]
            b = b.set_column(n, b.schema.field(n), pa.array(sizes, b.schema.field(n).type))
        yield b


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (columns as they are) with every found span in ``text`` redacted
    and ``n_chars``, if there, counted anew for changed rows; a null text stays
    null, a text without findings stays byte for byte."""
    return docs.mapInArrow(_redacted, docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = "{}:{}:{}".format
    for b in batches:
        cols: list[list] = [[] for _ in range(9)]
        for t in b.column(1).to_pylist():
            spans = find_spans(t)
            kinds = [k for k, _, _ in spans]
            base = ",".join(line(*x) for x in spans if x[0] in BASE_KINDS)
            for c, v in zip(cols, [kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(line(*x) for x in spans), *(kinds.count(k) for k in KINDS[3:])], strict=True):
                c.append(v)
        kinds_ = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds_, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_der", "n_ssh", "n_jwt", "n_pem"])


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of :func:`find_spans` per row, for the query contract."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_der long, n_ssh long, n_jwt long, n_pem long")
