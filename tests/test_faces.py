"""The API, the tool calls, exports and the store."""

import json

import pytest

from histlake import fixtures
from histlake.operators import listing
from histlake.plans.filters import Filter
from histlake.sinks import api, export
from histlake.store import Store, migrated


@pytest.fixture(scope="module")
def commands(spark, sf):
    return fixtures.commands(spark, sf).persist()


def test_api(commands):
    rows = api.web_commands(commands, Filter(limit=5))
    assert [r["id"] for r in rows] == sorted((r["id"] for r in rows), reverse=True)
    groups = api.web_breakdown(commands, "session", Filter(limit=15))
    assert all(g["raw"] == g["key"][1:] for g in groups)
    assert sum(g["count"] for g in groups) >= sum(sum(g["spark"]) for g in groups) > 0
    assert api.drill_key("exit", "?", "?") == ""
    assert api.drill_key("cwd", "/a", "/[REDACTED]") == ""
    assert api.drill_key("day", "2024-01-02", "2024-01-02") == "2024-01-02"
    assert api.snippet_html("a\x01<\x02", "a<") == "a<mark>&lt;</mark>"
    assert api.snippet_html("k\x01ey\x02", "[REDACTED]") == "[REDACTED]"
    assert api.span_note(commands).startswith(", activity 2024-01-01 → ")


def test_tools(spark, commands):
    assert api.tool_list(commands, Filter(limit=3)).startswith("3 command(s)")
    assert "match(es)" in api.tool_search(commands, "tion", Filter(limit=3), context=1)
    assert api.tool_search(commands, "zzzzzz", Filter()) == "no recorded commands matched 'zzzzzz'"
    assert api.tool_get(commands, -1).startswith("#1000 ")
    assert api.tool_diff(commands, 900, 901)
    with pytest.raises(api.NotFound):
        api.tool_get(commands, 10**9)
    rows = [(1, "x", None, 0, 1000, None, "a\nb\n", None, None), (2, "x", None, 0, 2000, None, "a\ntoken=abcdef\n", None, None)]
    own = spark.createDataFrame(rows, "id long, cmd string, cwd string, exit_code int, started_ms long, ended_ms long, plain string, machine string, note string")
    text = api.tool_diff(own, -1)
    assert "-b\n" in text
    assert "abcdef" not in text


def test_exports(commands):
    rows = export.prepared(listing.newest_then_oldest_first(commands, Filter(limit=3)), redacted=True)
    found = json.loads(export.json_array(rows).first()[0])
    assert [r["id"] for r in found] == sorted(r["id"] for r in found)
    cast = export.asciicast(rows).first()[0].splitlines()
    assert json.loads(cast[0])["version"] == 2
    times = [json.loads(x)[0] for x in cast[1:]]
    assert times == sorted(times)
    assert export.html_page(rows).first()[0].count("<section>") == 3
    assert export.document(export.markdown(rows, details=True)).first()[0].count("<details>") == 3
    assert export.stats_table(__import__("histlake.operators.stats", fromlist=["x"]).breakdown(commands, "exit", 3)).count() == 3


def test_store(spark, commands, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(commands.limit(200))
    store.append(spark.createDataFrame([(5000, 1, "curl -H token=verysecret", 0, "")], "id long, session_id long, cmd string, started_ms long, plain string"))
    assert store.commands().count() == 201
    store.set_note(5000, "mine", 1)
    assert store.commands().filter("id = 5000").first()["note"] == "mine"
    with pytest.raises(KeyError):
        store.set_note(10**9, "x", 2)
    store.delete(5000, 3)
    store.delete(10**9, 3)
    assert store.commands().count() == 200
    assert store.redact() >= 1
    assert b"verysecret" not in b"".join(p.read_bytes() for p in tmp_path.rglob("*.parquet"))
    assert store.raw().filter("id = 5000").first()["cmd"] == "curl -H token=[REDACTED]"
    with pytest.raises(ValueError, match="version"):
        migrated(store.raw(), 99)


def test_stored_postings(spark, commands, tmp_path):
    store = Store(spark, str(tmp_path / "p"))
    half = commands.filter("id <= 500")
    store.append(half)
    want = [r.id for r in store.search("nting", Filter(limit=40)).collect()]  # a scan
    store.index()
    assert [r.id for r in store.search("NTING", Filter(limit=40)).collect()] == want
    store.append(commands.filter("id > 500"))
    rows = Store(spark, str(tmp_path / "p")).search("nting", Filter(limit=40))
    assert [r.id for r in rows.collect()] == [r.id for r in store.commands().filter("contains(plain_lc, 'nting')").orderBy(*listing.newest()).limit(40).collect()]
    assert "PartitionFilters: [isnotnull(bucket" in rows._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in rows._jdf.queryExecution().toString()
    first = rows.first().id
    store.delete(first, 1)
    assert first not in [r.id for r in store.search("nting", Filter(limit=40)).collect()]


def test_stored_postings_follow_redaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(1, "export TOKEN=ghp_" + "a1B2" * 9, 86_400_000), (2, "ls", 86_400_000)], "id long, cmd string, started_ms long")
    store.append(rows.selectExpr("*", "'' AS plain"))
    store.index()
    assert [r.id for r in store.search("ghp_a1b2").collect()] == [1]
    assert store.redact() == 1
    assert store.search("ghp_a1b2").isEmpty()
    assert not store.spark.read.parquet(str(tmp_path / "r" / "postings")).filter("tri = 'ghp'").count()


def test_one_shot_capture(spark, tmp_path):
    from histlake.sources import oneshot

    seen = []
    a = oneshot.run(["sh", "-c", "echo out; echo err >&2; exit 3"], show=seen.append)
    assert (a.exit_code, a.output, b"".join(seen), a.truncated) == (3, b"out\nerr\n", b"out\nerr\n", False)
    assert a.cmd == "sh -c 'echo out; echo err >&2; exit 3'"
    assert oneshot.run(["sh", "-c", "kill -TERM $$"]).exit_code == 143
    assert oneshot.run([str(tmp_path / "none")]).exit_code == 127
    left = oneshot.run(["sh", "-c", "sleep 20 & echo done"])
    assert left.exit_code == 0 and left.output == b"done\n" and left.ended_ms - left.started_ms < 10_000
    cut = oneshot.run(["sh", "-c", "printf '%050d' 7"], head_cap=4, tail_cap=4)
    assert cut.truncated and cut.output.startswith(b"0000\n") and cut.output.endswith(b"0007")
    store = Store(spark, str(tmp_path / "s"))
    store.append(oneshot.recorded(spark, [a, left, cut], 7, 1, ["^sh -c 'printf"]))
    assert [(r.id, r.exit_code, r.plain) for r in store.commands().orderBy("id").collect()] == [(7, 3, "out\nerr\n"), (8, 0, "done\n")]
