"""Merging, retention, histories, segments."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from histlake import fixtures
from histlake.operators import listing, merge, retention, stats
from histlake.operators.running import with_rank, with_running
from histlake.sources import history as h
from histlake.sources import segments


@pytest.fixture(scope="module")
def commands(spark, sf):
    return fixtures.commands(spark, sf).persist()


def test_running_sums(spark):
    rows = with_running(spark.range(1000), F.floor(F.col("id") / 37), [F.col("id")], F.col("id"), "s").collect()
    assert all(r.s == r.id * (r.id + 1) // 2 for r in rows)
    assert sorted(r.k for r in with_rank(spark.range(0, 500, 7), "id", "k", 16).collect()) == list(range(72))


def test_previous_run(spark):
    schema = "id long, cmd string, started_ms long, machine string"
    rows = spark.createDataFrame([(1, "ls", 10, None), (2, "date", 20, None), (3, "ls", 25, "hist:zsh"), (4, "ls", 3 * 86_400_000, None)], schema)
    assert {r.id: r.prev_id for r in listing.previous_runs(rows).collect()} == {1: None, 2: None, 3: 1, 4: 1}
    assert [r.id for r in listing.previous_run(rows, 4).collect()] == [1]
    assert listing.previous_run(rows, 1).isEmpty()


def test_histogram_edges(spark):
    day = 86_400_000
    schema = "id long, cmd string, started_ms long, ended_ms long, exit_code int"
    rows = spark.createDataFrame([(1, "ls", day, None, 0), (2, "ls", 13 * day, None, 0), (3, "ls", 7 * day, None, 1), (4, "ls", 0, None, 0)], schema)
    (r,) = stats.activity(rows, "cmd").collect()
    assert r.spark[0] == r.spark[11] == 1
    assert sum(r.spark) == 3
    (one,) = stats.activity(rows.filter("id = 1"), "cmd").collect()
    assert one.spark[11] == 1
    (none,) = stats.activity(rows.filter("id = 4"), "cmd").collect()
    assert none.spark is None


def test_merge_is_idempotent(commands):
    batch = commands.filter("machine is not null").withColumn("file_pos", F.col("id"))
    added = merge.insert_or_ignore(commands.filter("id < 0"), batch.unionByName(batch))
    assert added.count() == batch.count()
    assert merge.insert_or_ignore(commands, batch).isEmpty()


def test_prune_to_size(commands):
    total = retention.payload_sum(commands).first()[0]
    kept = retention.prune_to_size(commands, total // 2)
    left = retention.payload_sum(kept).first()[0]
    assert 0 < left <= total // 2
    assert retention.prune_to_size(kept, total // 2).count() == kept.count()
    assert kept.filter("started_ms = 0").isEmpty()


def test_prune_by_age(commands):
    assert retention.prune_by_age(commands, 1).filter("started_ms = 0").isEmpty()
    assert not retention.prune_by_age(commands, 1, keep_unknown=True).filter("started_ms = 0").isEmpty()


def test_rewrite_removes_the_secret(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "x password=hunter2", "d1"), (2, "fine", "d2")], "id long, cmd string, started_day string")
    rows.write.partitionBy("started_day").parquet(path)
    retention.rewrite_days(spark, path, ["d1"], retention.redacted)
    data = b"".join(p.read_bytes() for p in (tmp_path / "t").rglob("*.parquet"))
    assert b"hunter2" not in data
    assert spark.read.parquet(path).count() == 2


def test_rewrite_drops_emptied_days_and_finishes_a_cut_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "d1"), (2, "b", "d2"), (3, "c", "d3")], "id long, cmd string, started_day string").write.partitionBy("started_day").parquet(path)
    retention.rewrite_days(spark, path, ["d1", "d2"], lambda rows: rows.filter("id <> 1"))
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == [2, 3]
    assert not (tmp_path / "t" / "started_day=d1").exists()
    assert not (tmp_path / "t__rewrite").exists()
    # A rewrite that broke off between the delete and the rename of a day, and one before its rows were all written.
    side = tmp_path / "t__rewrite"
    spark.read.parquet(path).filter("id = 2").write.partitionBy("started_day").parquet(str(side / "rows"))
    spark.createDataFrame([("d2", True), ("d3", False)], "day string, kept boolean").coalesce(1).write.json(str(side / "days"))
    import shutil

    shutil.rmtree(tmp_path / "t" / "started_day=d2")
    retention.finish_rewrite(spark, path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]
    spark.range(1).write.parquet(str(side / "rows"))
    retention.finish_rewrite(spark, path)
    assert not side.exists()
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]


def test_redaction_reaches_raw_output_notes_and_the_log(spark, tmp_path):
    from histlake.store import Store

    store = Store(spark, str(tmp_path / "s"))
    day = 1_704_844_800_000
    rows = [
        (1, "fine", day, b"\x1b[1mpassword=\x1b[0mhunter2abc", "", None), (2, "curl", day, b"ok \x1b[1mbold\x1b[0m", "ok bold", "password=hunter2note"),
        (3, "ls", 0, b"plain", "plain", None),
    ]
    store.append(spark.createDataFrame(rows, "id long, cmd string, started_ms long, output binary, plain string, note string"))
    store.set_note(3, "password=hunter2log", 5)
    assert store.redact() == 3
    files = [p for p in (tmp_path / "s").rglob("*") if p.is_file()]
    assert files
    whole = [tuple(r) for r in spark.read.parquet(str(tmp_path / "s" / "commands")).collect()] + [tuple(r) for r in store.mutations().collect()]
    assert "hunter2" not in repr(whole)
    assert not any(b"hunter2" in p.read_bytes() for p in files)
    found = {r.id: r for r in store.commands().collect()}
    assert bytes(found[2].output) == b"ok \x1b[1mbold\x1b[0m"
    assert found[1].output is not None and len(found) == 3
    assert found[3].note and "password" in found[3].note
    assert store.redact() == 0


def test_store_version(spark, tmp_path):
    from histlake import schema
    from histlake.store import Store

    store = Store(spark, str(tmp_path / "v"))
    assert store.version() == 0
    store.append(spark.createDataFrame([(1, "a", 0, "")], "id long, cmd string, started_ms long, plain string"))
    assert Store(spark, str(tmp_path / "v")).version() == schema.VERSION
    spark.createDataFrame([(schema.VERSION + 1,)], "version int").write.mode("overwrite").json(str(tmp_path / "v" / "version"))
    with pytest.raises(ValueError, match="version"):
        Store(spark, str(tmp_path / "v"))


def test_rows_of_unknown_time_are_cut_by_id(spark):
    rows = [(k, f"c{k % 3}", 0 if k % 2 else k * 40_000_000, None, 10, "", 1) for k in range(400)]
    table = spark.createDataFrame(rows, "id long, cmd string, started_ms long, machine string, output_bytes long, plain string, exit_code int")
    from histlake.operators import listing, running

    blocks = table.select(running.time_block(86_400_000, 50).alias("b"), "started_ms").filter("started_ms = 0").groupBy("b").count().collect()
    assert len(blocks) == 8
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    last, want, total, sums = {}, {}, 0, {}
    for r in order:
        want[r[0]] = last.get(r[1])
        last[r[1]] = r[0]
        total += 10 + 0 + len(r[1]) + retention.ROW_COST
        sums[r[0]] = total
    assert {r.id: r.prev_id for r in listing.previous_runs(table).collect()} == want
    assert {r.id: r.running for r in retention.prune_plan(table, 10**9).collect()} == sums


def test_heads_in_the_jvm_equal_those_in_python(spark):
    from histlake.functions.commandline import command_head, head_of

    lines = ["ls -la", "git status", "sudo make test", "FOO=1 x", "/usr/bin/ls", "a|b", "python3.12 -m x", "g++ a.c", "x\ny", "-v x", "", " ls", "cmd&", "a.b c", "env", "tab\tx", "é x", "ls", "a;b", "2>x ls"]
    rows = spark.createDataFrame([(x,) for x in lines] + [(None,)], "cmd string").select("cmd", command_head(F.col("cmd")).alias("head")).collect()
    assert {r.cmd: r.head for r in rows} == {None: None} | {x: head_of(x) for x in lines}


def test_reindex(spark):
    rows = spark.createDataFrame([(1, "", b"\x1b[1mHi\x1b[0m"), (2, "kept", b"x")], "id long, plain string, output binary")
    assert [(r.plain, r.plain_lc) for r in retention.reindex(rows).orderBy("id").collect()] == [("Hi", "hi"), ("kept", "kept")]


def test_zsh(tmp_path):
    data = b": 1785174961:0;echo multi\\\nline two\n: 1785174961:0;echo un\xc3\x83\x8fcode\n: 1785174961:2;sleep 2\n"
    a, b, c = h.parse_zsh(data)
    assert a.cmd == "echo multi\nline two"
    assert b.cmd == "echo unïcode"
    assert (c.cmd, c.ended_ms - c.started_ms, [x.seq for x in (a, b, c)]) == ("sleep 2", 2000, [1785174961000, 1785174961001, 1785174961002])
    assert h.parse_zsh(b"plain\n\n  \n")[0].started_ms == 0


def test_bash():
    data = b"#1785175363\necho hi\n#1785175363\necho 'multi\nline'\nplain one\nls \\\n-la\n"
    assert [(e.cmd, e.started_ms > 0) for e in h.parse_bash(data)] == [("echo hi", True), ("echo 'multi\nline'", True), ("plain one", False), ("ls \\\n-la", False)]
    assert [e.cmd for e in h.parse_bash(b"#123\n#17851753630000\n")] == ["#123", "#17851753630000"]


def test_other_text_histories():
    fish = h.parse_fish(b"- cmd: echo \\\\a\\nb\\q\n  when: 1785174985\n  paths:\n    - x\n- cmd: two\n")
    assert [(e.cmd, e.started_ms) for e in fish] == [("echo \\a\nb\\q", 1785174985000), ("two", 0)]
    assert [e.cmd for e in h.parse_nu(b"a<\\n>b\n\nc\n")] == ["a\nb", "c"]
    assert [e.cmd for e in h.parse_pwsh(b"one\nif {`\n  two`\n}\nthree `q` x\ntail`")] == ["one", "if {\n  two\n}", "three `q` x", "tail"]


def test_databases(spark, tmp_path):
    atuin, nu = tmp_path / "atuin.db", tmp_path / "nu.sqlite3"
    with sqlite3.connect(atuin) as db:
        db.execute("CREATE TABLE history(id text, command text, timestamp integer, duration integer, exit integer, cwd text, hostname text, deleted_at integer)")
        db.executemany("INSERT INTO history VALUES (?,?,?,?,?,?,?,?)", [
            ("a", "echo first", 1_785_000_000_123_000_000, 5_000_000, 0, "/tmp/lab", "demo-host:user", None), ("b", "false", 1_785_000_001_000_000_000, 0, -1, "unknown", "demo-host:user", None),
            ("c", "gone", 1, 1, 0, "/", "x:y", 5), ("d", "", 1, 1, 0, "/", "x:y", None),
        ])
    with sqlite3.connect(nu) as db:
        db.execute("CREATE TABLE history(id integer, command_line text, start_timestamp integer, cwd text, hostname text, duration_ms integer, exit_status integer)")
        db.executemany("INSERT INTO history VALUES (?,?,?,?,?,?,?)", [(1, "ls", 1_785_000_000_000, "/x", "box.example.com", 120, 0), (2, "pwd", None, None, ".odd", None, None)])
    first, second = h.read_atuin(str(atuin))
    assert (first.host, first.exit_code, first.started_ms, first.ended_ms) == ("demo-host", 0, 1_785_000_000_123, 1_785_000_000_128)
    assert (second.cwd, second.exit_code) == ("", None)
    assert [(e.host, e.exit_code, e.ended_ms) for e in h.read_nu_sqlite(str(nu))] == [("box", 0, 1_785_000_000_120), (".odd", None, None)]
    found = h.read_history_database(spark, str(atuin), "atuin")
    assert [r.cmd for r in found.orderBy("file_pos").collect()] == ["echo first", "false"]
    spark.dataSource.register(h.HistorySource)
    same = spark.read.format("shell_history").option("source", "atuin").load(str(atuin))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, found.collect()))
    rows = h.to_commands(found, "atuin", local_host="demo-host").collect()
    assert {r.machine for r in rows} == {"hist:atuin"}
    assert {r.host for r in rows} == {None}


def test_detection_and_patterns(tmp_path):
    (tmp_path / ".zsh_history").write_text("x")
    (tmp_path / ".bash_history").write_text("")
    assert h.detect_sources(str(tmp_path)) == [("zsh", str(tmp_path / ".zsh_history"))]
    assert h.load_patterns("a+\n# c\n\n(\nb") == ["a+", "b"]


def test_segments(spark, commands, tmp_path):
    key = bytes(range(32))
    local = commands.filter("machine is null")
    segments.write_segments(segments.seal(local, "abc", key, 100_000), str(tmp_path / "log"))
    state = spark.createDataFrame([("abc", 100)], "machine string, last_seq long")
    fresh = segments.read_segments(spark, str(tmp_path / "log"), "me", state)
    records = segments.open_segments(fresh, key, state)
    assert records.count() == local.filter("id > 100").count()
    assert segments.read_segments(spark, str(tmp_path / "log"), "abc", state).isEmpty()
    with pytest.raises(Exception, match="(?i)aes|tag|decrypt"):
        segments.open_segments(fresh.withColumn("first", F.col("first") + 1), key, state).collect()
    with pytest.raises(Exception, match="(?i)aes|tag|decrypt"):
        segments.open_segments(fresh, bytes(32), state).collect()


def test_export_counters(commands):
    from pyspark.sql import Observation

    seen = Observation()
    rows = merge.export_rows(commands, 0, ["^ls"], seen).count()
    local = commands.filter("machine is null")
    assert seen.get == {"exported": rows, "skipped": local.filter("cmd like 'ls%'").count()}
