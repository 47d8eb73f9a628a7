"""The segmenter: golden streams, any chunking, batch against stream; the capture buffer; echo replay."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from histlake.streaming.capture import HeadTail, capture, clip_bytes, gap_note
from histlake.streaming.echo import INPUT_MARK, PROMPT_MARK, reconstruct
from histlake.streaming.segmenter import UNKNOWN, Segmenter

OSC = lambda s: b"\x1b]" + s + b"\x07"
TELL = lambda s: OSC(b"6973;cmd=" + base64.b64encode(s.encode()))
BASIC = TELL("echo hi") + OSC(b"133;C") + b"hi\r\n" + OSC(b"133;D;0") + OSC(b"7;file://host/home/x")


def run(*chunks, **options):
    machine = Segmenter(**options)
    out = [c for x in chunks for c in machine.feed(x)]
    return out + machine.finish()


def test_basic():
    (c,) = run(BASIC)
    assert (c.cmd, c.output, c.plain, c.exit_code, c.cwd, c.truncated) == ("echo hi", b"hi\r\n", "hi\n", 0, "", False)
    assert run(BASIC, BASIC)[1].cwd == "/home/x"


@pytest.mark.parametrize(
    ("stream", "names"),
    [
        (OSC(b"133;C") + b"x" + OSC(b"133;D;1"), [UNKNOWN]),
        (OSC(b"133;C") + OSC(b"2;title") + OSC(b"133;D;1"), []),
        (OSC(b"133;D;0"), []),
        (TELL("exit") + OSC(b"133;C") + b"exit\n" + OSC(b"133;D;0"), []),
        (OSC(b"133;C") + b"logout\r\n", []),
        (OSC(b"133;C;cmdline_url=ls%20-l") + OSC(b"133;D"), ["ls -l"]),
        (OSC(b"133;C;cmdline=ls\\ x") + OSC(b"133;D"), ["ls x"]),
        (OSC(b"633;E;a\\x3b b;nonce") + OSC(b"633;C") + OSC(b"633;D;0"), ["a; b"]),
        (OSC(b"133;A") + b"$ " + OSC(b"133;B") + b"git st\r\n" + OSC(b"133;C") + OSC(b"133;D;0"), ["git st"]),
        (TELL("a") + OSC(b"133;C") + OSC(b"133;C") + b"z" + OSC(b"133;D;0"), ["a"]),
        (OSC(b"6973;rec=off") + BASIC + OSC(b"6973;rec=on") + BASIC, ["echo hi"]),
        (TELL("open") + OSC(b"133;C") + b"partial", ["open"]),
        (OSC(b"1337;SetUserVar=WEZTERM_PROG=" + base64.b64encode(b"make")) + OSC(b"133;C") + OSC(b"133;D;0"), ["make"]),
    ],
)
def test_names(stream, names):
    assert [c.cmd for c in run(stream)] == names


def test_split_user_variable():
    whole = base64.b64encode(b"x" * 130)
    rows = [whole[k : k + 76] for k in range(0, len(whole), 76)]
    stream = OSC(b"1337;SetUserVar=WEZTERM_PROG=" + rows[0]) + OSC(b"1337;SetUserVar=" + rows[1] + b"=" + rows[2]) + OSC(b"133;C") + OSC(b"133;D;0")
    assert [c.cmd for c in run(stream)] == ["x" * 130]


def test_alternate_screen_and_foreign_sequences():
    (c,) = run(TELL("vi") + OSC(b"133;C") + b"a\x1b[?1049hHIDDEN\x1b[?1049lb\x1b]0;t\x1b\\" + OSC(b"133;D;130"))
    assert c.plain == "ab"
    assert b"HIDDEN" not in c.output
    assert c.output.endswith(b"\x1b]0;t\x07")
    assert c.exit_code == 130


def test_ignored():
    assert run(BASIC, ignore=("^echo",)) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=25), st.integers(0, 3))
def test_any_chunking(cuts, extra):
    stream = (BASIC + OSC(b"133;A") + b"$ " + OSC(b"133;B") + b"ls\x1b[K\r\n" + OSC(b"133;C") + b"\x1b[1mbold\x1b[0m" + OSC(b"133;D;2")) * 2 + b"\x1b" * extra
    places = sorted({c for c in cuts if c < len(stream)})
    parts = [stream[a:b] for a, b in zip([0, *places], [*places, len(stream)])]
    assert run(*parts) == run(stream)


def test_overlong_sequences_stay_bounded():
    machine = Segmenter()
    for _ in range(40):
        machine.feed(b"\x1b]" + b"x" * 10_000)
    assert len(machine.pending) < 70_000


def test_capture_against_a_plain_model():
    rng = random.Random(7)
    for _ in range(500):
        head, tail = rng.randint(1, 20), rng.randint(1, 20)
        buffer, whole = HeadTail(head, tail), b""
        for _ in range(rng.randint(0, 8)):
            x = bytes(rng.randrange(256) for _ in range(rng.randint(0, 15)))
            buffer.write(x)
            whole += x
        gap = len(whole) - head - tail
        want = whole if gap <= 0 else whole[:head] + gap_note(gap) + whole[-tail:]
        assert buffer.value() == want
        assert buffer.truncated() == (gap > 0)


def test_capture_in_plans(spark):
    chunks = spark.createDataFrame([(1, 1, b"lo"), (1, 0, b"hel"), (2, 0, b"x" * 40)], "k long, seq long, data binary")
    rows = {r.k: r for r in capture(chunks, "k", head=4, tail=3).collect()}
    assert bytes(rows[1].output) == b"hello"
    assert bytes(rows[2].output) == b"xxxx" + gap_note(33) + b"xxx"
    one = spark.range(1).select(clip_bytes(F.lit(b"x" * 40), 4, 3)).first()[0]
    assert bytes(one) == bytes(rows[2].output)


@pytest.mark.parametrize(
    ("echo", "line"),
    [
        (b"ls -la\r\n", "ls -la"), (b"git psuh\b\b\bush\r\n", "git push"), (b"abc\x1b[2D\x1b[KX\r\n", "aX"), (b"abc\x1b[3D\x1b[Pz\r\n", "zc"), (b"ac\x1b[D\x1b[@b\r\n", "abc"),
        (b"bad^C", ""), (b"x\x1b[5;5Hy\r\n", ""), (b"a\x1b[?1049hpicker\x1b[?1049lb\r\n", "ab"), (b"one\r\ntwo\r\n", "one\ntwo"), (b"  \r\n", ""),
        (PROMPT_MARK + b"$ " + INPUT_MARK + b"ls\r\n", "ls"), (PROMPT_MARK + b"$ " + INPUT_MARK + b"a \\\r\n" + PROMPT_MARK + b"> " + INPUT_MARK + b"b\r\n", "a \\\nb"),
        ("é★\r\n".encode(), "é★"),
    ],
)
def test_echo(echo, line):
    assert reconstruct(echo, 40) == line


def test_echo_wraps_and_decorations():
    assert reconstruct(b"x" * 25 + b"\r\n", 10) == "x" * 25
    assert reconstruct(b"ls\x1b[16G12:00\r\n", 20) == "ls"


def chunk_rows():
    rng = random.Random(3)
    rows = []
    for session in range(5):
        stream = b"".join(TELL(f"cmd {session} {k}") + OSC(b"133;C") + b"out\r\n" * k + OSC(b"133;D;%d" % (k % 3)) for k in range(6))
        cuts = sorted(rng.sample(range(len(stream)), 9))
        for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(stream)])):
            rows.append((session, seq, stream[a:b]))
    return rows


def test_batch_equals_stream(spark, tmp_path):
    from histlake.streaming.jobs import segment_batch, segment_stream

    rows = chunk_rows()
    schema = "session_id long, seq long, data binary"
    at = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("seq"))
    chunks = spark.createDataFrame(rows, schema).withColumn("ts", at)
    batch = sorted(tuple(r) for r in segment_batch(chunks).select("session_id", "n", "cmd", "exit_code", "plain", "ended_ms").collect())
    assert len(batch) == 30
    random.Random(5).shuffle(rows)
    for k in range(3):  # late and out of order, over three files
        spark.createDataFrame(rows[k::3], schema).withColumn("ts", at).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = segment_stream(live).select("session_id", "n", "cmd", "exit_code", "plain", "ended_ms")
    query = out.writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("segments").collect()) == batch


def test_timers_end_sessions_and_give_up_gaps(spark, tmp_path):
    import time

    from histlake.streaming.jobs import segment_stream

    rows = [
        (1, 0, TELL("make") + OSC(b"133;C") + b"building\r\n"),  # no end mark
        (2, 0, TELL("ls") + OSC(b"133;C") + b"one\r\n"), (2, 2, OSC(b"133;D;3") + TELL("pwd") + OSC(b"133;C") + b"/\r\n" + OSC(b"133;D;0")),  # chunk 1 is lost
        (3, 0, TELL("exit") + OSC(b"133;C")),
    ]
    chunks = spark.createDataFrame(rows, "session_id long, seq long, data binary").withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000)))
    chunks.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    out = segment_stream(live, quiet_ms=1000).select("session_id", "n", "cmd", "exit_code", "plain")
    query = out.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    want = [(1, 0, "make", None, "building\n"), (2, 0, "ls", 3, "one\n"), (2, 1, "pwd", 0, "/\n")]
    until = time.time() + 90
    while time.time() < until and spark.table("timed").count() < len(want):
        time.sleep(0.5)
    query.stop()
    assert sorted(tuple(r) for r in spark.table("timed").collect()) == want


def test_merges_read_the_batch_s_ranges_only(spark, tmp_path):
    from histlake.streaming import jobs

    schema = "machine string, origin_seq long, cmd string"
    table = spark.createDataFrame([(f"m{k % 3}", k, f"c{k}") for k in range(30)] + [(None, None, "local")], schema)
    batch = spark.createDataFrame([("m0", 12, "x"), ("m0", 18, "x"), ("m2", 2, "x"), ("new", 1, "x"), (None, 5, "x")], schema)
    near = jobs.known_rows(table, batch)
    assert sorted((r.machine, r.origin_seq) for r in near.collect()) == [("m0", 12), ("m0", 15), ("m0", 18), ("m2", 2)]
    most, jobs.MACHINE_FILTERS = jobs.MACHINE_FILTERS, 1
    try:
        wide = jobs.known_rows(table, batch)
        assert {r.origin_seq for r in wide.collect()} == set(range(1, 19))
    finally:
        jobs.MACHINE_FILTERS = most
    table.write.parquet(str(tmp_path / "t"))
    batch.write.parquet(str(tmp_path / "b"))
    for run in range(2):  # the same batch twice: once in
        jobs.merge_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "b")), str(tmp_path / "t"), str(tmp_path / f"cp{run}")).trigger(availableNow=True).start().awaitTermination(60)
    keys = [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).filter("machine = 'new'").select("machine", "origin_seq").collect()]
    assert keys == [("new", 1)]
