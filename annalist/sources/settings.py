"""Settings and lens definitions, read on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from pathlib import Path

# Defaults of settings and of the first lens.
DIMENSIONS = ("thinking", "workstyle", "habits", "traits", "biases", "state", "goals", "feedback")
MAX_CONCURRENCY = 16
#: What the first lens asks of its models.
DEFAULT_PROMPTS = {
    "extract": "Read the transcript. List what it shows of the user, as a JSON array of objects with dimension, observation, evidence and poignancy (1 to 10). Give [] if it shows nothing.\n",
    "review": "Read the present facets and the new observations. Give the facets that they support or change, as a JSON array of objects with dimension, key, value, confidence (0 to 1), because_of (ids) and contradicts_prior.\n",
}
#: Keys of a scope, and other names that they may be given under.
SCOPED = ("runner", "mine_model", "review_model")
SYNONYMS = {"triage_model": "mine_model", "extract_model": "mine_model", "distill_model": "review_model"}
COUNTS = ("review_every", "review_poignancy", "mine_concurrency", "chunk_max_chars", "review_max_chars")


@dataclass(frozen=True)
class Settings:
    review_every: int = 5
    review_poignancy: int = 30
    mine_concurrency: int = 4
    chunk_max_chars: int = 0
    review_max_chars: int = 16_000
    runner: str = ""
    mine_model: str = ""
    review_model: str = ""
    lenses: tuple[str, ...] = ()
    other: dict[str, str] = field(default_factory=dict)


def _unquoted(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) >= 2 and x[0] == x[-1] and x[0] in "\"'" else x


def canonical_key(key: str) -> str:
    """The name of a scoped setting, whatever name it is given under; other keys as they are."""
    told = key.strip().lower()
    return SYNONYMS.get(told, told if told in SCOPED else key.strip())


def parse_settings(text: str) -> Settings:
    """``key = value`` lines; comments, unknown keys and bad numbers are passed
    over; ``lens`` may be repeated; values that make no sense fall back."""
    out, lenses, other = Settings(), [], {}
    for line in text.splitlines():
        key, sep, value = line.partition("=")
        key, value = canonical_key(key), _unquoted(value)
        if not sep or key.startswith("#"):
            continue
        if key == "lens":
            lenses += [value] if value and value not in lenses else []
        elif key in SCOPED:
            out = replace(out, **{key: value.strip()})
        elif key in COUNTS:
            if re.fullmatch(r"-?\d+", value):
                out = replace(out, **{key: int(value)})
        else:
            other[key] = value
    base = Settings()
    for key in ("review_every", "mine_concurrency", "review_max_chars"):
        if getattr(out, key) <= 0:
            out = replace(out, **{key: getattr(base, key)})
    return replace(out, lenses=tuple(lenses), other=other, chunk_max_chars=max(0, out.chunk_max_chars))


def set_key(text: str, key: str, value: str) -> str:
    """The settings text with one key set, in its place if it is there."""
    lines, done = text.splitlines(), False
    key = canonical_key(key)
    for i, line in enumerate(lines):
        if canonical_key(line.partition("=")[0]) == key:
            lines[i], done = f"{key} = {value}", True
    return "\n".join([*lines, *([] if done else [f"{key} = {value}"])]) + "\n"


def unset_key(text: str, key: str) -> str:
    """The settings text without a key."""
    kept = [x for x in text.splitlines() if canonical_key(x.partition("=")[0]) != canonical_key(key)]
    return "\n".join(kept) + "\n" * bool(kept)


@dataclass(frozen=True)
class Lens:
    name: str
    dimensions: tuple[str, ...] = DIMENSIONS
    prompts: dict[str, str] = field(default_factory=dict)
    runner: str = ""
    model: str = ""
    review_model: str = ""


#: Where lens.json keeps each scoped setting.
LENS_FIELDS = {"runner": "runner", "mine_model": "extract_model", "review_model": "review_model"}


def lens_spec(folder: str | Path) -> dict:
    path = Path(folder) / "lens.json"
    return json.loads(path.read_text()) if path.exists() else {}


def load_lens(folder: str | Path, reserved_as: str = "") -> Lens:
    """A lens out of a folder with lens.json and prompt files. A reserved name is
    refused, or replaced by ``reserved_as`` for one that is only looked at."""
    folder = Path(folder)
    if not folder.is_dir():
        raise ValueError(f"{folder} is no folder")
    spec = lens_spec(folder)
    name = spec.get("name") or folder.name
    if re.sub(r"[^A-Za-z0-9_-]", "_", name).lower() == "unified":
        if not reserved_as:
            raise ValueError("the name is reserved")
        name = reserved_as
    prompts = {p.stem: p.read_text() for p in sorted(folder.glob("*.md"))}
    own = {key: spec.get(field) or "" for key, field in LENS_FIELDS.items()}
    return Lens(name, tuple(spec.get("dimensions") or DIMENSIONS), prompts, own["runner"], own["mine_model"], own["review_model"])


def write_lens(folder: str | Path, spec: dict, prompts: dict[str, str]) -> None:
    """A lens folder; an existing one is replaced file by file."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in {"lens.json": json.dumps(spec, indent=2), **{f"{k}.md": v for k, v in prompts.items()}}.items():
        beside = folder / f".{name}.new"
        beside.write_text(body)
        beside.replace(folder / name)


def time_bound(text: str, now: datetime, end: bool = False) -> datetime:
    """A bound of a time range: RFC 3339, a UTC date (the end of it for an upper
    bound), or an age such as 7d, 2w, 1h30m."""
    if re.fullmatch(r"(?:\d+(?:\.\d+)?[dwhms])+", text):
        unit = {"d": "days", "w": "weeks", "h": "hours", "m": "minutes", "s": "seconds"}
        return now - sum((timedelta(**{unit[u]: float(n)}) for n, u in re.findall(r"([\d.]+)([dwhms])", text)), timedelta())
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = datetime.fromisoformat(text).replace(tzinfo=UTC)
        return day + timedelta(days=1, microseconds=-1) if end else day
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return when if when.tzinfo else when.replace(tzinfo=UTC)


def time_range(since: str, until: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    a = time_bound(since, now) if since else None
    b = time_bound(until, now, True) if until else None
    if a and b and a > b:
        raise ValueError("the range ends before it begins")
    return a, b


def concurrency(asked: int, cores: int, safe: bool = True) -> int:
    return max(1, min(asked, MAX_CONCURRENCY, cores)) if safe else 1
