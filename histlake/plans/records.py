"""Queries of the history parsers and of the text functions, with their SQL.

History files are made from the events by rule, one for each user, in the
format of each shell; some commands have two lines. The SQL gives the commands
as they were before they were written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.commandline import exec_quote, shell_join, shell_quote, shell_unquote
from ..functions.highlight import highlight
from ..functions.terminal import strip_ansi
from ..operators import listing, merge, retention
from ..schema import started_day
from ..sources import history, segments
from .catalog import _DUR, NEWEST, TO_MS, _took_sql, query, table_query

_CMD = "CASE event_id % 5 WHEN 0 THEN concat('echo ''a', chr(10), 'b ', event_id, '''') WHEN 1 THEN concat('printf %s ', event_id, ' | sort') ELSE concat('echo ', event_id) END"
_SECOND = "1704067200 + event_id % 400"
_PARSED = "user_id long, pos int, cmd string, started_ms long, ended_ms long, seq long"


def _parsed(events: DataFrame, line: Column, parse: Callable[[bytes], list[history.Entry]]) -> DataFrame:
    """The entries of each user's file; ``line`` may use the columns cmd and second."""
    lines = events.selectExpr("user_id", "event_id", f"{_CMD} AS cmd", f"{_SECOND} AS second").select("user_id", F.struct(F.col("second"), F.col("event_id"), line.alias("line")).alias("l"))
    files = lines.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, k, e.cmd, e.started_ms, e.ended_ms, e.seq) for u, data in zip(batch["user_id"], batch["data"], strict=True) for k, e in enumerate(parse(data.encode()))]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])
            yield out.astype({"ended_ms": "Int64"})

    return files.mapInPandas(run, _PARSED)


def _dated(ended: str) -> str:
    place = "row_number() OVER (PARTITION BY user_id{} ORDER BY second, event_id) - 1"
    return (
        f"WITH e AS (SELECT user_id, event_id, {_CMD} AS cmd, {_SECOND} AS second FROM events) SELECT user_id, {place.format('')} AS pos, cmd, CAST(second * 1000 AS BIGINT) AS started_ms, "
        f"CAST({ended} AS BIGINT) AS ended_ms, CAST(second * 1000 + least({place.format(', second')}, 999) AS BIGINT) AS seq FROM e"
    )


_UNDATED = f"WITH e AS (SELECT user_id, event_id, {_CMD} AS cmd, {_SECOND} AS second FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY second, event_id) - 1 AS pos, cmd FROM e"


@table_query("events", _dated("(second + 3) * 1000"))
def import_zsh(e: DataFrame) -> DataFrame:
    line = F.format_string(": %d:3;%s\n", F.col("second"), F.replace(F.col("cmd"), F.lit("\n"), F.lit("\\\n")))
    return _parsed(e, line, history.parse_zsh)


@table_query("events", _dated("NULL"))
def import_bash(e: DataFrame) -> DataFrame:
    return _parsed(e, F.format_string("#%d\n%s\n", F.col("second"), F.col("cmd")), history.parse_bash)


@table_query("events", _dated("NULL"))
def import_fish(e: DataFrame) -> DataFrame:
    line = F.format_string("- cmd: %s\n  when: %d\n  paths:\n    - x\n", F.replace(F.col("cmd"), F.lit("\n"), F.lit("\\n")), F.col("second"))
    return _parsed(e, line, history.parse_fish)


@table_query("events", _UNDATED)
def import_nu(e: DataFrame) -> DataFrame:
    return _parsed(e, F.concat(F.replace(F.col("cmd"), F.lit("\n"), F.lit("<\\n>")), F.lit("\n")), history.parse_nu).select("user_id", "pos", "cmd")


@table_query("events", _UNDATED)
def import_pwsh(e: DataFrame) -> DataFrame:
    return _parsed(e, F.concat(F.replace(F.col("cmd"), F.lit("\n"), F.lit("`\n")), F.lit("\n")), history.parse_pwsh).select("user_id", "pos", "cmd")


def _exec_sql(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[A-Za-z0-9_@%+=:,./-]+') THEN {x} ELSE '''' || replace({x}, '''', '''\\''''') || '''' END"


@query(f"SELECT id, {_exec_sql('cmd')} AS quoted, {_exec_sql('cmd')} || ' ' || {_exec_sql(chr(99) + 'oalesce(cwd, ' + chr(39) * 2 + ')')} AS joined FROM commands")
def exec_quoted(c: DataFrame) -> DataFrame:
    return c.select("id", exec_quote(F.col("cmd")).alias("quoted"), shell_join(F.array("cmd", F.coalesce("cwd", F.lit("")))).alias("joined"))


@table_query("documents", "SELECT doc_id, text AS word FROM documents")
def shell_unquoted(d: DataFrame) -> DataFrame:
    """Texts quoted for a shell and read back."""
    return d.select("doc_id", shell_unquote(shell_quote(F.col("text"))).alias("word"))


@table_query("documents", "SELECT doc_id, text AS decoded FROM documents")
def percent_decoded(d: DataFrame) -> DataFrame:
    return d.select("doc_id", tx.decode_percent(F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))).alias("decoded"))


@table_query("documents", "SELECT doc_id, text AS decoded FROM documents")
def marks_decoded(d: DataFrame) -> DataFrame:
    """Texts escaped as editors' shell marks are, and decoded."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit(";"), F.lit("\\x3b")), F.lit("\n"), F.lit("\\x0a"))
    return d.select("doc_id", tx.decode_vsc(escaped).alias("decoded"))


@query(f"SELECT id, CASE WHEN started_ms > 0 AND ended_ms >= started_ms THEN {_took_sql('(ended_ms - started_ms)')} ELSE '' END AS span FROM commands")
def span_text(c: DataFrame) -> DataFrame:
    return c.select("id", tx.short_duration(F.col("started_ms"), F.col("ended_ms")).alias("span"))


@query(
    f"SELECT id, CASE WHEN started_ms <= 0 THEN 'time unknown' WHEN {TO_MS} - started_ms < 60000 THEN 'just now' WHEN {TO_MS} - started_ms < 3600000 THEN (({TO_MS} - started_ms) // 60000) || 'm ago' "
    f"WHEN {TO_MS} - started_ms < 86400000 THEN (({TO_MS} - started_ms) // 3600000) || 'h ago' ELSE strftime(make_timestamp(started_ms * 1000), '%b %d %H:%M') END AS ago FROM commands WHERE started_ms <= {TO_MS}"
)
def ago_text(c: DataFrame) -> DataFrame:
    return c.filter(F.col("started_ms") <= TO_MS).select("id", tx.ago(F.col("started_ms"), TO_MS).alias("ago"))


@query("SELECT id, CASE WHEN started_ms > 0 THEN strftime(CAST(make_timestamp(started_ms * 1000) AS DATE) + 1, '%Y-%m-%d') END AS next FROM commands")
def next_days(c: DataFrame) -> DataFrame:
    return c.select("id", tx.next_day(started_day()).alias("next"))


@query(
    "SELECT id, CASE WHEN coalesce(host, '') = '' THEN '' ELSE '@' || host END AS host, (id % 3) || ' command' || CASE WHEN id % 3 = 1 THEN '' ELSE 's' END AS number, "
    "CASE WHEN started_ms > 0 THEN strftime(make_timestamp(started_ms * 1000), '%Y-%m-%d %H:%M:%S') ELSE 'time unknown' END AS time, "
    "CASE WHEN cwd = '/src/app' THEN '~' WHEN starts_with(cwd, '/src/app/') THEN '~' || cwd[9:] ELSE cwd END AS dir FROM commands"
)
def labels_text(c: DataFrame) -> DataFrame:
    return c.select("id", tx.host_tag(F.col("host")).alias("host"), tx.plural(F.col("id") % 3, "command").alias("number"), tx.when(F.col("started_ms")).alias("time"), tx.home_label(F.col("cwd"), "/src/app").alias("dir"))


@query("SELECT id, regexp_replace(cmd, '(?i)S', chr(1) || '\\0' || chr(2), 'g') AS marked FROM commands")
def highlighted(c: DataFrame) -> DataFrame:
    return c.select("id", highlight(F.col("cmd"), F.lit("S")).alias("marked"))


@query("SELECT id, cmd FROM commands WHERE machine IS NULL AND id > 300 ORDER BY id LIMIT 50")
def pending_page(c: DataFrame) -> DataFrame:
    """A page of unsynced rows after a key."""
    return merge.pending(c, 300).orderBy("id").limit(50).select("id", "cmd")


@query(f"SELECT row_number() OVER (ORDER BY started_ms, id) AS line, id FROM (SELECT id, started_ms FROM commands {NEWEST} LIMIT 20)")
def display_order(c: DataFrame) -> DataFrame:
    """The newest rows as a terminal shows them, oldest first."""
    from pyspark.sql import Window

    shown = listing.newest_then_oldest_first(c).select("id", "started_ms")  # twenty rows
    return shown.select(F.row_number().over(Window.orderBy("started_ms", "id")).cast("long").alias("line"), "id")


@table_query("events", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def state_upserts(e: DataFrame) -> DataFrame:
    """The last state written for each key."""
    return retention.latest(e.select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "value")


@table_query("documents", "SELECT doc_id, replace(text, chr(9), ' ') AS plain, lower(replace(text, chr(9), ' ')) AS plain_lc FROM documents")
def reindexed(d: DataFrame) -> DataFrame:
    """Search text made anew from raw output in bold."""
    raw = F.encode(F.concat(F.lit("\x1b[1m"), F.col("text"), F.lit("\x1b[0m")), "UTF-8")
    rows = retention.reindex(d.select("doc_id", F.lit("").alias("plain"), raw.alias("output")))
    return rows.select("doc_id", "plain", "plain_lc")


@query(f"SELECT id, CASE WHEN {_DUR} < 0 THEN -1 ELSE {_DUR} END AS dur FROM commands")
def durations(c: DataFrame) -> DataFrame:
    from ..schema import duration_ms

    return c.select("id", F.when(duration_ms() < 0, F.lit(-1).cast("long")).otherwise(duration_ms()).alias("dur"))


@table_query("documents", "SELECT doc_id, replace(replace(text, chr(9), ' '), 'the', 'THE') AS plain FROM documents")
def overwritten_lines(d: DataFrame) -> DataFrame:
    """Progress lines overwritten after a carriage return, letters taken back, and styles: only the last state shows."""
    typed = F.replace(F.col("text"), F.lit("the"), F.lit("xx\b\b\x1b[1;32mTHE\x1b[0m"))
    return d.select("doc_id", strip_ansi(F.concat(F.lit("10%\r50%\r\x1b[2K"), typed)).alias("plain"))


@query("SELECT id AS origin_seq, cmd, cwd, exit_code, started_ms, ended_ms, host, note, plain FROM commands WHERE machine IS NULL AND id > 700", slim=False)
def sealed_segments(c: DataFrame) -> DataFrame:
    """Local rows past the mark 700, sealed in segments of about 100 kB and opened again."""
    state = c.sparkSession.createDataFrame([("here", 700)], "machine string, last_seq long")
    key = bytes(range(32))
    sealed = segments.seal(c.filter("machine is null"), "here", key, 100_000)
    opened = segments.open_segments(sealed, key, state)
    return opened.select("origin_seq", "cmd", "cwd", "exit_code", "started_ms", "ended_ms", "host", "note", "plain")


_MARKED = "CASE event_id % 4 WHEN 0 THEN '/osc7/' WHEN 1 THEN '/current/' WHEN 2 THEN '/mark/' ELSE '/nine/' END || (event_id % 7) || ' x'"


@table_query(
    "events",
    f"SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CASE event_id % 3 WHEN 0 THEN 'typed ' || event_id ELSE 'told ' || event_id END AS cmd, "
    f"{_MARKED} AS cwd, CAST(event_id % 5 AS INT) AS exit_code, 'out ' || event_id AS plain FROM events",
)
def segment_marks(e: DataFrame) -> DataFrame:
    """Sessions whose directories come by four kinds of mark, whose commands are told or only echoed, and whose screens of programs are left out."""
    from ..streaming.jobs import segment_batch

    place = F.concat_ws("", F.expr("CASE event_id % 4 WHEN 0 THEN '/osc7/' WHEN 1 THEN '/current/' WHEN 2 THEN '/mark/' ELSE '/nine/' END"), (F.col("event_id") % 7).cast("string"))
    cwd = (
        F.when(F.expr("event_id % 4 = 0"), F.concat(F.lit("\x1b]7;file://h"), place, F.lit("%20x\x07")))
        .when(F.expr("event_id % 4 = 1"), F.concat(F.lit("\x1b]1337;CurrentDir="), place, F.lit(" x\x07")))
        .when(F.expr("event_id % 4 = 2"), F.concat(F.lit("\x1b]633;P;Cwd="), place, F.lit("\\x20x\x07")))
        .otherwise(F.concat(F.lit('\x1b]9;9;"'), place, F.lit(' x"\x07')))
    )
    own = F.col("event_id").cast("string")
    typed = F.concat(F.lit("\x1b]133;A\x07$ \x1b]133;B\x07typd\bed "), own, F.lit("\r\n"))
    told = F.concat(F.lit("\x1b]633;E;told\\x20"), own, F.lit(";n\x07"))
    start = F.concat(F.when(F.expr("event_id % 3 = 0"), typed).otherwise(told), F.lit("\x1b]133;C\x07"))
    screen = F.when(F.expr("event_id % 2 = 0"), F.lit("\x1b[?1049hscreen\x1b[?1049l")).otherwise("")
    end = F.concat(F.lit("\x1b]133;D;"), (F.col("event_id") % 5).cast("string"), F.lit("\x07"))
    data = F.concat(cwd, start, F.lit("out "), screen, own, end)
    chunks = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.timestamp_millis(F.lit(1_700_000_000_000)).alias("ts"), F.encode(data, "UTF-8").alias("data"))
    return segment_batch(chunks).select("session_id", "n", "cmd", "cwd", "exit_code", "plain")
