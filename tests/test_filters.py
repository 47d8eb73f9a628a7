import datetime as dt

import pytest

from histlake.operators import listing
from histlake.plans import filters as f

NOW = int(dt.datetime(2026, 7, 1, 12, tzinfo=dt.UTC).timestamp() * 1000)
DAY = 86_400_000


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, 1, "make", "/src/app", 2, NOW - 3000, NOW - 2000, "", None, None, None, None),
        (2, 1, "ls", "/src/app/sub", 0, NOW - 2000, NOW - 1000, "", None, None, None, None),
        (3, 2, "cat", "/src/apple", 1, NOW - 1000, None, "", None, None, None, None),
        (4, 2, "old", None, 0, NOW - 2 * DAY, None, "", "m1", "laptop", 9, None),
        (5, 0, "undated", None, None, 0, None, "", "hist:zsh", None, 10, None),
    ]
    schema = "id long, session_id long, cmd string, cwd string, exit_code int, started_ms long, ended_ms long, plain string, machine string, host string, origin_seq long, note string"
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(
    ("where", "ids"),
    [
        (f.Filter(), [3, 2, 1, 4, 5]),
        (f.Filter(cwd="/src/app"), [2, 1]),
        (f.Filter(cwd="/src/app/"), [2, 1]),
        (f.Filter(cwd="/"), [3, 2, 1, 4, 5]),
        (f.Filter(failed=True), [3, 1]),
        (f.Filter(exit_code=0), [2, 4]),
        (f.Filter(exit_code=0, failed=True), [2, 4]),
        (f.Filter(session=2), [3, 4]),
        (f.Filter(since_ms=NOW - DAY), [3, 2, 1]),
        (f.Filter(until_ms=NOW - DAY), [4, 5]),
        (f.Filter(host="local"), [3, 2, 1]),
        (f.Filter(host="laptop"), [4]),
        (f.Filter(limit=2), [3, 2]),
        (f.Filter(cwd="/src/app", failed=True), [1]),
    ],
)
def test_filter(rows, where, ids):
    assert [r.id for r in listing.recent(rows, where).collect()] == ids


@pytest.mark.parametrize(("n", "want"), [(0, 3), (-1, 3), (-2, 2), (-3, 1), (2, 2), (-9, None), (99, None)])
def test_get(rows, n, want):
    found = listing.get(rows, n).collect()
    assert [r.id for r in found] == ([] if want is None else [want])


def test_limit_is_no_filter():
    assert not f.Filter(limit=5).active()
    assert f.Filter(session=1).active()
    assert f.Filter().rows() == 20


@pytest.mark.parametrize(
    ("text", "ago"), [("30m", 30 * 60_000), ("2h", 2 * 3_600_000), ("1.5d", 1.5 * DAY), ("1w", 7 * DAY), ("1h30m", 90 * 60_000), ("45s", 45_000)]
)
def test_relative_time(text, ago):
    assert f.time_spec(text, NOW) == NOW - int(ago)


@pytest.mark.parametrize(("text", "want"), [("2026-06-30", (2026, 6, 30)), ("2026-06-30 08:15", (2026, 6, 30, 8, 15)), ("2026-06-30T08:15", (2026, 6, 30, 8, 15))])
def test_absolute_time(text, want):
    assert f.time_spec(text, NOW) == int(dt.datetime(*want, tzinfo=dt.UTC).timestamp() * 1000)


@pytest.mark.parametrize("text", ["", "soon", "5x", "-2h", "2026-13-01"])
def test_bad_time(text):
    with pytest.raises(f.FilterError):
        f.time_spec(text, NOW)


@pytest.mark.parametrize(
    ("text", "want"), [("0", 0), ("10", 10), ("1k", 1024), ("1K", 1024), ("1KB", 1024), ("1KiB", 1024), ("1.5M", 1572864), ("2G", 2 << 30), ("1T", 1 << 40), ("64B", 64)]
)
def test_size(text, want):
    assert f.parse_size(text) == want


@pytest.mark.parametrize("text", ["", "x", "-1K", "1X"])
def test_bad_size(text):
    with pytest.raises(f.FilterError):
        f.parse_size(text)


def test_ages():
    assert f.prune_age_ms("30d") == 30 * DAY
    assert f.prune_age_ms("12h") == DAY // 2
    with pytest.raises(f.FilterError):
        f.prune_age_ms("2w")


def test_front_ends():
    assert f.from_params({"exit": "x", "limit": "9999", "cwd": "rel"}, NOW) == f.Filter(cwd="rel", limit=50)
    assert f.from_flags({"cwd": "../b", "exit": "0"}, NOW, here="/a/c") == f.Filter(cwd="/a/b", exit_code=0)
    assert f.from_arguments({"limit": 500, "failed": True}, NOW) == f.Filter(failed=True, limit=100)
    with pytest.raises(f.FilterError):
        f.from_arguments({"exit": "x"}, NOW)
    assert f.split_flags(["a", "--failed", "--cwd", "/x", "b", "-n=3", "--", "--c"]) == ({"failed": "true", "cwd": "/x", "n": "3"}, ["a", "b", "--c"])
