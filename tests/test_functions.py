from datetime import UTC, datetime

import pytest

from annalist.functions.replies import parse_array
from annalist.functions.scalars import k_band
from annalist.operators.text import chunk_bounds
from annalist.sources.settings import concurrency, parse_settings, set_key, time_bound, time_range


@pytest.mark.parametrize(
    "reply, status, n",
    [
        ('[{"a": 1}]', "array", 1),
        ('Sure:\n```json\n[{"a": 1}, {"a": 2}]\n```\nbye', "array", 2),
        ('[{"a": 1}] then [{"b": 2}, {"b": 3}]', "array", 2),
        ('{"items": [{"a": 1}]}', "array", 1),
        ('{"x": [{"a": 1}]} and []', "array", 1),
        ("nothing today: []", "empty", 0),
        ("- [ ] a task\n- [ ] another", "none", 0),
        ("1. [ ] a task", "none", 0),
        ('[{"a": "x"}, {"a": "y', "truncated", 0),
        ('[] and then [{"a": ', "truncated", 0),
        ("[see the notes", "none", 0),
        ('"[1, 2" is text', "none", 0),
        ("[1, 2]", "none", 0),
        ("", "none", 0),
        (None, "none", 0),
        ('[{"a": "br]acket"}]', "array", 1),
    ],
)
def test_replies(reply, status, n):
    got, items = parse_array(reply)
    assert (got, len(items)) == (status, n)


def test_later_array_wins():
    assert parse_array('[{"a": 1}]\n[{"a": 2}]')[1] == [{"a": 2}]


@pytest.mark.parametrize(
    "sizes, budget, bounds",
    [([], 10, []), ([5, 5], 0, [(0, 2)]), ([50], 10, [(0, 1)]), ([4, 4, 4, 4, 4], 12, [(0, 3), (1, 4), (2, 5)]), ([20, 3, 3], 10, [(0, 1), (1, 3)]), ([5, 5, 5], 10, [(0, 2), (2, 3)])],
)
def test_chunks(sizes, budget, bounds):
    assert chunk_bounds(sizes, budget) == bounds


def test_chunks_cover_everything_and_end():
    for n in range(1, 30):
        got = chunk_bounds([(7 * k) % 11 + 1 for k in range(n)], 20)
        assert got[0][0] == 0 and got[-1][1] == n
        assert all(a < c <= b for (a, b), (c, _) in zip(got, got[1:]))


def test_band():
    assert k_band(2) == [1]
    assert k_band(3) == [2]
    assert k_band(500) == list(range(2, 10))


def test_settings():
    s = parse_settings("# x\nreview_every = 0\nchunk_max_chars = '50'\nlens = a\nlens = \"b\"\nlens = a\nodd = 1\nreview_poignancy = no\n")
    assert (s.review_every, s.chunk_max_chars, s.lenses, s.other, s.review_poignancy) == (5, 50, ("a", "b"), {"odd": "1"}, 30)
    assert parse_settings(set_key("a = 1\nb = 2\n", "b", "3")).other == {"a": "1", "b": "3"}
    assert concurrency(99, 8) == 8 and concurrency(4, 8, safe=False) == 1


def test_time_bounds():
    now = datetime(2026, 7, 10, tzinfo=UTC)
    assert time_bound("7d", now).day == 3
    assert time_bound("2026-07-08", now, True).hour == 23
    with pytest.raises(ValueError):
        time_range("2026-07-09", "2026-07-08", now)


def test_years_beyond_9999_have_no_sign(spark):
    from pyspark.sql import functions as F

    from annalist.functions import scalars as X

    rows = spark.createDataFrame([(253402300799999, "9999-12-31T23:59:59-01:00"), (253402300800000, "2024-01-01"), (5999999 * 86400123, "x"), (0, "")], "ms long, ts string")
    got = [tuple(r) for r in rows.select(X.millis_ts(F.col("ms")), X.normal_ts(F.col("ts"), F.lit("-"))).collect()]
    assert got == [("9999-12-31T23:59:59Z", "10000-01-01T00:59:59Z"), ("10000-01-01T00:00:00Z", "2024-01-01T00:00:00Z"), ("18397-06-18T12:59:59Z", "-"), ("", "-")]


def test_a_long_string_is_scanned_without_a_stack():
    import tracemalloc

    reply = '[{"a": "' + "ab\\n" * 500_000 + '"}]'
    tracemalloc.start()
    try:
        status, items = parse_array(reply)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert status == "array" and len(items[0]["a"]) == 1_500_000
    assert most < 20 * len(reply)
