"""Tolerant extraction of a JSON array of objects from a model's reply.

Places are looked at in order: fenced blocks marked as JSON, other fenced blocks,
the whole reply. Arrays outside braces win over nested ones; among arrays of one
kind the last that isn't empty wins. An array that is opened and never closed is
a truncated reply; an empty array (but for a list check box) means nothing was
found; anything else is drift.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd

ARRAY, EMPTY, TRUNCATED, NONE = "array", "empty", "truncated", "none"
# One step of a scan outside strings: a string (perhaps unended) or a bracket.
# Possessive: a string of any length is passed without a stack.
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+(?:"|\\?\Z)|[\[\]{}]', re.S)
_CHECKBOX = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s*$")
_FENCE = re.compile(r"```([^\n]*)\n(.*?)```", re.S)


def _spans(text: str) -> tuple[list[tuple[int, int, bool]], int | None]:
    """(start, end, outside braces) of outermost balanced arrays, and where the
    first array that is never closed opens. An unclosed one is passed over, so
    that arrays inside it count."""
    tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text) if text[m.start()] != '"']
    closes: dict[int, int] = {}
    stack: list[int] = []
    for at, (_, t) in enumerate(tokens):
        if t == "[":
            stack.append(at)
        elif t == "]" and stack:
            closes[stack.pop()] = at
    found, unclosed, curly, at = [], None, 0, 0
    while at < len(tokens):
        pos, t = tokens[at]
        if t == "{":
            curly += 1
        elif t == "}":
            curly = max(0, curly - 1)
        elif t == "[":
            if at in closes:
                at = closes[at]
                found.append((pos, tokens[at][0] + 1, curly == 0))
            elif unclosed is None:
                unclosed = pos
        at += 1
    return found, unclosed


def _objects(text: str) -> list | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, list) and all(x is None or isinstance(x, dict) for x in found) else None


def _checkbox(text: str, at: int) -> bool:
    return bool(_CHECKBOX.match(text[text.rfind("\n", 0, at) + 1 : at]))


def parse_array(reply: str | None) -> tuple[str, list[dict]]:
    """(array | empty | truncated | none, the objects)."""
    reply = reply or ""
    blocks = [(m[1].strip().lower() in ("json", "jsonc"), m[2]) for m in _FENCE.finditer(reply)]
    places = [b for is_json, b in blocks if is_json] + [b for is_json, b in blocks if not is_json] + [reply]
    empty, best = False, {True: None, False: None}
    unclosed = None
    for place in places:
        spans, unclosed = _spans(place)
        for start, end, outside in spans:
            got = _objects(place[start:end])
            if got:
                best[outside] = got
            elif got is not None and not _checkbox(place, start):
                empty = True
    for got in (best[True], best[False]):
        if got:
            return ARRAY, [x or {} for x in got]
    if unclosed is not None and re.search(r'[{"]', reply[unclosed + 1 :]):
        return TRUNCATED, []
    return (EMPTY, []) if empty else (NONE, [])


def parse_replies(fields: Sequence[str], reply: str = "reply"):
    """For mapInPandas: adds status and items, each item's fields as text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_array(x) for x in b[reply]]
            b["status"] = [s for s, _ in parsed]
            b["items"] = [[{f: _text(x.get(f)) for f in fields} for x in items] for _, items in parsed]
            yield b

    return run


def _text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)
