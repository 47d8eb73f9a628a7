"""Every query over the test tables by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..fixtures import SLIM_SQL, SQL
from ..functions import text as tx
from ..functions.redact import hits, redact_lean
from ..operators import listing, merge, retention, search, stats
from ..session import ship
from .filters import Filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Points in time of the events: ten days in, and twenty.
FROM_MS, TO_MS = 1704844800000, 1705708800000


def query(sql: str | None = None, slim: bool = True):
    """Registers a function of the command table; ``sql`` may use the table ``commands``."""

    def add(f):
        view = fixtures.slim_commands if slim else fixtures.commands
        QUERIES[f.__name__] = lambda spark, sf_dir: ship(spark) or f(view(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (SLIM_SQL if slim else SQL) + sql
        return f

    return add


def table_query(table: str, sql: str | None = None):
    """Registers a function of one test table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: ship(spark) or f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SUMMARY = "id, session_id, cmd, coalesce(cwd, '') AS cwd, exit_code, started_ms, ended_ms, coalesce(machine, '') AS machine, coalesce(host, '') AS host, coalesce(note, '') AS note"
NEWEST = "ORDER BY started_ms DESC, id DESC"


def _listed(where: str, limit: int = 20) -> str:
    return f"SELECT {SUMMARY} FROM commands WHERE {where} {NEWEST} LIMIT {limit}"


@query(_listed("true"))
def list_recent(c: DataFrame) -> DataFrame:
    return listing.recent(c)


@query(f"SELECT {SUMMARY} FROM commands {NEWEST} LIMIT 1 OFFSET 6")
def list_offset(c: DataFrame) -> DataFrame:
    return listing.summary(listing.get(c, -7))


@query(f"SELECT {SUMMARY} FROM commands WHERE id = 42")
def get_by_id(c: DataFrame) -> DataFrame:
    return listing.summary(listing.get(c, 42))


@query(f"SELECT {SUMMARY} FROM commands {NEWEST} LIMIT 1")
def get_latest(c: DataFrame) -> DataFrame:
    return listing.summary(listing.get(c, 0))


def _filtered(name: str, where: Filter, sql: str) -> None:
    """A filter over the whole table: every row that passes."""
    QUERIES[name] = lambda spark, sf_dir: listing.summary(where.apply(fixtures.slim_commands(spark, sf_dir)))
    ORACLES[name] = SLIM_SQL + f"SELECT {SUMMARY} FROM commands WHERE {sql}"


_filtered("filter_session", Filter(session=7), "session_id = 7")
_filtered("filter_cwd_subtree", Filter(cwd="/src/app"), "cwd = '/src/app' OR starts_with(cwd, '/src/app/')")
_filtered("filter_exit", Filter(exit_code=2), "exit_code = 2")
_filtered("filter_exit_zero", Filter(exit_code=0, failed=True), "exit_code = 0")
_filtered("filter_failed", Filter(failed=True), "exit_code IS NOT NULL AND exit_code <> 0")
_filtered("filter_since", Filter(since_ms=FROM_MS), f"started_ms >= {FROM_MS}")
_filtered("filter_until", Filter(until_ms=TO_MS), f"started_ms < {TO_MS}")
_filtered("filter_window", Filter(since_ms=FROM_MS, until_ms=TO_MS), f"started_ms >= {FROM_MS} AND started_ms < {TO_MS}")
_filtered("filter_host", Filter(host="laptop"), "host = 'laptop'")
_filtered("filter_host_local", Filter(host="local"), "machine IS NULL")


@query(_listed(f"exit_code IS NOT NULL AND exit_code <> 0 AND (cwd = '/src/app' OR starts_with(cwd, '/src/app/')) AND started_ms >= {FROM_MS} AND machine IS NULL", 50))
def filter_combo(c: DataFrame) -> DataFrame:
    return listing.recent(c, Filter(failed=True, cwd="/src/app", since_ms=FROM_MS, host="local", limit=50))


@query("SELECT count(*) AS commands, coalesce(sum(output_bytes), 0) AS output_bytes, min(started_ms) AS oldest_ms, count(machine) AS imported FROM commands", slim=False)
def overview_stats(c: DataFrame) -> DataFrame:
    return stats.overview(c)


_DUR = "CASE WHEN started_ms > 0 AND ended_ms IS NOT NULL THEN ended_ms - started_ms END"
KEYS = {
    "exit": "coalesce(CAST(exit_code AS VARCHAR), '?')",
    "cwd": "coalesce(cwd, '')",
    "host": "CASE WHEN coalesce(host, '') = '' THEN 'local' ELSE host END",
    "session": "CASE WHEN session_id > 0 THEN '#' || session_id ELSE '(imported)' END",
    "day": "CASE WHEN started_ms > 0 THEN strftime(make_timestamp(started_ms * 1000), '%Y-%m-%d') ELSE 'unknown' END",
    # Heads of the view's five commands.
    "cmd": "CASE cmd WHEN 'git status' THEN 'git status' WHEN 'ls -la' THEN 'ls' WHEN 'sudo make test' THEN 'make test' WHEN 'docker compose up -d' THEN 'docker compose' ELSE 'curl' END",
}


def _breakdown_sql(dimension: str) -> str:
    return (
        f"SELECT {KEYS[dimension]} AS key, count(*) AS count, count(*) FILTER (exit_code <> 0) AS fails, "
        f"CAST(coalesce(sum({_DUR}) FILTER ({_DUR} > 0), 0) AS BIGINT) AS dur_ms, "
        f"(count(*) FILTER (exit_code <> 0) * 100 + count(*) // 2) // count(*) AS fail_pct FROM commands GROUP BY 1"
    )


for _d in stats.DIMENSIONS:
    QUERIES[f"stats_by_{_d}"] = lambda spark, sf_dir, d=_d: ship(spark) or stats.breakdown(fixtures.slim_commands(spark, sf_dir), d)
    ORACLES[f"stats_by_{_d}"] = SLIM_SQL + _breakdown_sql(_d)


@query(f"SELECT * FROM ({_breakdown_sql('session')}) ORDER BY CASE WHEN key = '(imported)' THEN -1 ELSE CAST(key[2:] AS BIGINT) END DESC LIMIT 15")
def stats_top_sessions(c: DataFrame) -> DataFrame:
    return stats.breakdown(c, "session", 15)


@query(f"SELECT * FROM (SELECT * FROM ({_breakdown_sql('day')}) ORDER BY key DESC LIMIT 7) ORDER BY key")
def stats_last_days(c: DataFrame) -> DataFrame:
    return stats.breakdown(c, "day", 7)


@query("SELECT min(started_ms) FILTER (started_ms > 0) AS first, max(started_ms) FILTER (started_ms > 0) AS last FROM commands")
def time_range(c: DataFrame) -> DataFrame:
    return stats.time_range(c)


_BUCKET = "CASE WHEN started_ms > 0 THEN CASE WHEN l = f THEN 11 ELSE CAST((CAST(started_ms - f AS HUGEINT) * 1000000 * 12) // (CAST(l - f AS HUGEINT) * 1000000 + 1) AS INT) END END"


def _activity_sql(dimension: str) -> str:
    return (
        f", r AS (SELECT min(started_ms) FILTER (started_ms > 0) AS f, max(started_ms) FILTER (started_ms > 0) AS l FROM commands), "
        f"b AS (SELECT {KEYS[dimension]} AS key, {_BUCKET} AS b FROM commands, r) "
        f"SELECT key, {', '.join(f'count(*) FILTER (b = {k}) AS b{k}' for k in range(12))} FROM b GROUP BY key"
    )


@query(_activity_sql("exit"))
def activity_histogram(c: DataFrame) -> DataFrame:
    return stats.activity(c, "exit").select("key", *[F.col("spark")[k].cast("long").alias(f"b{k}") for k in range(12)])


@query(
    _activity_sql("day").replace("SELECT key, ", "SELECT key, '' AS x, ").split("SELECT key, '' AS x")[0]
    + "SELECT key, list_aggregate(list_transform(range(12), lambda k: CASE WHEN coalesce(h[k + 1], 0) = 0 THEN ' ' ELSE '▁▂▃▄▅▆▇█'[(h[k + 1] * 8 - 1) // list_max(h) + 1] END), 'string_agg', '') AS line "
    f"FROM (SELECT key, [{', '.join(f'count(*) FILTER (b = {k})' for k in range(12))}] AS h FROM b GROUP BY key)"
)
def sparkline(c: DataFrame) -> DataFrame:
    return stats.activity(c, "day").select("key", stats.sparkline(F.col("spark")).alias("line"))


QUERY_WORD = "NTING"
_HIT = f"contains(lower(plain), '{QUERY_WORD.lower()}') OR contains(lower(cmd), '{QUERY_WORD.lower()}')"


@query(f"SELECT id, started_ms, cmd FROM commands WHERE {_HIT} {NEWEST} LIMIT 20", slim=False)
def search_substring(c: DataFrame) -> DataFrame:
    return search.search_ids(c, QUERY_WORD)


@query(f"SELECT id, started_ms, note FROM commands WHERE contains(lower(note), '0% d') {NEWEST} LIMIT 20")
def search_notes(c: DataFrame) -> DataFrame:
    return search.notes(c, "0% D")


@query(f"SELECT id, started_ms, cmd FROM commands WHERE contains(lower(plain), 'note') OR contains(lower(cmd), 'note') OR contains(lower(note), 'note') {NEWEST} LIMIT 100", slim=False)
def search_union(c: DataFrame) -> DataFrame:
    return search.search_ids(c, "note", Filter(limit=100))


@query("SELECT id, started_ms, cmd FROM commands WHERE contains(lower(note), 'do') ORDER BY started_ms DESC, id DESC LIMIT 20", slim=False)
def search_short_query(c: DataFrame) -> DataFrame:
    """Two characters: notes only."""
    return search.search_ids(c, "do")


@query(
    f", h AS (SELECT id, plain, strpos(lower(plain), '{QUERY_WORD.lower()}') - 1 AS place, length(plain) AS n FROM commands WHERE {_HIT} {NEWEST} LIMIT 20), "
    # Twelve three-letter tokens, the word's own three in the middle.
    "b AS (SELECT id, plain, n, CASE WHEN place < 0 THEN 0 ELSE least(greatest(0, place - 4), greatest(0, n - 14)) END AS a FROM h) "
    f"SELECT id, CASE WHEN a > 0 THEN '…' ELSE '' END || regexp_replace(substr(plain, a + 1, 14), '(?i){QUERY_WORD}', chr(1) || '\\0' || chr(2), 'g') "
    "|| CASE WHEN a + 14 < n THEN '…' ELSE '' END AS snippet FROM b",
    slim=False,
)
def snippet(c: DataFrame) -> DataFrame:
    return search.search(c, QUERY_WORD).select("id", "snippet")


def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is indexed once, however many commands printed it."""
    ship(spark)
    rows, texts = fixtures.shared_commands(spark, sf_dir)
    return search.search_shared(rows, texts, search.trigrams(texts, "text_id", F.col("plain_lc")), QUERY_WORD)


QUERIES["search_postings"] = search_postings
ORACLES["search_postings"] = SQL + f"SELECT id, started_ms, cmd FROM commands WHERE {_HIT} {NEWEST} LIMIT 20"


_LINES = (
    "WITH t AS (SELECT doc_id AS id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents), "
    "e AS (SELECT id, unnest(range(len(l))) AS i, unnest(l) AS line FROM t), "
    "m AS (SELECT *, contains(lower(line), 'tion') AS is_match FROM e), "
    "k AS (SELECT *, max(CAST(is_match AS INT)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS keep FROM m), "
    "h AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) = 1 THEN 0 ELSE 1 END AS n FROM k WHERE keep = 1), "
    "g AS (SELECT id, i, line, is_match, CAST(sum(n) OVER (PARTITION BY id ORDER BY i) AS BIGINT) AS hunk FROM h) "
)


@table_query("documents", _LINES + "SELECT id, hunk, CAST(i AS INT) AS i, line, is_match FROM g")
def grep_context(d: DataFrame) -> DataFrame:
    return search.grep_lines(d.select(F.col("doc_id").alias("id"), F.col("text").alias("plain")), "TION", 1, 2)


@table_query(
    "documents",
    _LINES + "SELECT id, hunk, CAST(min(i) AS INT) AS start, string_agg(line, chr(10) ORDER BY i) AS body, count(*) FILTER (is_match) AS matches FROM g WHERE hunk <= 5 GROUP BY 1, 2",
)
def grep_hunks(d: DataFrame) -> DataFrame:
    rows = search.grep_hunks(d.select(F.col("doc_id").alias("id"), F.col("text").alias("plain")), "TION", 1, 2)
    return rows.select("id", "hunk", "start", F.array_join("lines", "\n").alias("body"), F.size(F.filter("is_match", lambda m: m)).cast("long").alias("matches"))


@table_query("documents", _LINES + "SELECT id, CAST(count(*) FILTER (is_match) AS BIGINT) AS total, CAST(count(*) FILTER (is_match AND hunk <= 5) AS BIGINT) AS shown FROM g GROUP BY id")
def grep_totals(d: DataFrame) -> DataFrame:
    return search.grep_totals(d.select(F.col("doc_id").alias("id"), F.col("text").alias("plain")), "TION", 1, 2)


@query(
    "SELECT id, last_value(CASE WHEN machine IS NULL OR NOT starts_with(machine, 'hist:') THEN id END IGNORE NULLS) OVER "
    "(PARTITION BY cmd ORDER BY started_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id FROM commands"
)
def prev_run(c: DataFrame) -> DataFrame:
    return listing.previous_runs(c)


@query(
    "SELECT id, cmd, started_ms FROM commands WHERE cmd = (SELECT cmd FROM commands WHERE id = 900) AND (machine IS NULL OR NOT starts_with(machine, 'hist:')) "
    "AND (started_ms, id) < (SELECT (started_ms, id) FROM commands WHERE id = 900) ORDER BY started_ms DESC, id DESC LIMIT 1"
)
def prev_run_single(c: DataFrame) -> DataFrame:
    return listing.previous_run(c, 900).select("id", "cmd", "started_ms")


@query(
    "SELECT id, session_id, cmd, coalesce(cwd, '') AS cwd, exit_code AS exit, started_ms AS started_at, "
    f"coalesce({_DUR}, -1) AS dur_ms, coalesce(host, '') AS host, coalesce(note, '') AS note, coalesce(starts_with(machine, 'hist:'), false) AS hist FROM commands"
)
def web_rows(c: DataFrame) -> DataFrame:
    return listing.web_row(c)


@query(f"SELECT {SUMMARY} FROM commands WHERE NOT regexp_matches(cmd, '^sudo |curl')")
def ignore_filter(c: DataFrame) -> DataFrame:
    return listing.summary(listing.without_ignored(c, ["^sudo ", "curl"]))


_BATCH = "SELECT event_id AS file_pos, user_id % 50 AS origin_seq, 'hist:' || event_type AS machine, event_type AS cmd FROM events"
_OLD = "SELECT 'hist:click' AS machine, user_id % 50 AS origin_seq FROM events WHERE user_id % 50 < 10"


@table_query(
    "events",
    f"WITH b AS ({_BATCH}), o AS ({_OLD}) SELECT machine, origin_seq, arg_min(cmd, file_pos) AS cmd FROM b "
    "WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.machine = b.machine AND o.origin_seq = b.origin_seq) GROUP BY machine, origin_seq",
)
def dedup_import(e: DataFrame) -> DataFrame:
    seq = F.col("user_id") % 50
    batch = e.select(F.col("event_id").alias("file_pos"), seq.alias("origin_seq"), F.concat(F.lit("hist:"), "event_type").alias("machine"), F.col("event_type").alias("cmd"))
    old = e.filter(seq < 10).select(F.lit("hist:click").alias("machine"), seq.alias("origin_seq")).distinct()
    return merge.insert_or_ignore(old, batch).select("machine", "origin_seq", "cmd")


@table_query(
    "events", "SELECT event_id, user_id * 1000 + least(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1, 999) AS seq FROM events"
)
def import_seq(e: DataFrame) -> DataFrame:
    return merge.import_seq(e.select("event_id", F.col("user_id").alias("sec"), F.col("event_id").alias("file_pos"))).select("event_id", "seq")


_SIZED = ", s AS (SELECT id, started_ms, output_bytes + strlen(plain) + strlen(cmd) + 128 AS size FROM commands), "


@query(
    _SIZED + "r AS (SELECT id, size, CAST(sum(size) OVER (ORDER BY started_ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM s) SELECT * FROM r WHERE running - size < 2000000",
    slim=False,
)
def prune_plan(c: DataFrame) -> DataFrame:
    return retention.prune_plan(c, 2_000_000)


@query(f"SELECT {SUMMARY} FROM commands WHERE started_ms >= {TO_MS}")
def prune_age(c: DataFrame) -> DataFrame:
    return listing.summary(retention.prune_by_age(c, TO_MS))


@query("SELECT CAST(sum(output_bytes + strlen(plain) + strlen(cmd) + 128) AS BIGINT) AS payload FROM commands", slim=False)
def payload_sum(c: DataFrame) -> DataFrame:
    return retention.payload_sum(c)


@query(
    "SELECT id, CASE WHEN id % 5 = 0 THEN nullif('n' || (id % 3 + 7), 'n7') WHEN id % 4 = 0 THEN 'old' ELSE note END AS note FROM commands WHERE id % 11 <> 0"
)
def notes_applied(c: DataFrame) -> DataFrame:
    """Two rounds of notes and one of deletions, over all rows."""
    first = c.filter("id % 4 = 0").selectExpr("id", "1 AS at", "'note' AS kind", "'old' AS note")
    second = c.filter("id % 5 = 0").selectExpr("id", "2 AS at", "'note' AS kind", "CASE WHEN id % 3 = 0 THEN '' ELSE concat('n', id % 3 + 7) END AS note")
    gone = c.filter("id % 11 = 0").selectExpr("id", "3 AS at", "'delete' AS kind", "CAST(NULL AS STRING) AS note")
    return retention.apply_mutations(c, first.unionByName(second).unionByName(gone)).select("id", "note")


def _re2(pattern: str) -> str:
    """A rule as RE2 takes it: folding covers Unicode there without a flag."""
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


def _redact_sql(column: str) -> str:
    from ..functions.redact import RULES

    for pattern, to in RULES:
        target = to.replace("$", "\\").replace("'", "''")
        column = f"regexp_replace({column}, '{_re2(pattern)}', '{target}', 'g')"
    return column


def _hits_sql() -> str:
    from ..functions.redact import RULES

    steps = []
    for k, (pattern, to) in enumerate(RULES):
        target = to.replace("$", "\\").replace("'", "''")
        steps.append(f"s{k} AS (SELECT doc_id, hits + CASE WHEN a <> t THEN len(regexp_extract_all(t, '{_re2(pattern)}')) ELSE 0 END AS hits, a AS t FROM "
                     f"(SELECT doc_id, hits, t, regexp_replace(t, '{_re2(pattern)}', '{target}', 'g') AS a FROM {f's{k - 1}' if k else 's'}))")  # fmt: skip
    return f"WITH s AS (SELECT doc_id, CAST(0 AS BIGINT) AS hits, text AS t FROM documents), {', '.join(steps)} SELECT doc_id, hits FROM s{len(RULES) - 1}"


@table_query("documents", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def redact_documents(d: DataFrame) -> DataFrame:
    return d.select("doc_id", redact_lean(F.col("text")).alias("text"))


@table_query("documents", _hits_sql())
def redact_hits(d: DataFrame) -> DataFrame:
    return d.select("doc_id", hits(F.col("text")).cast("long").alias("hits"))


@table_query("pages", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(p: DataFrame) -> DataFrame:
    return p.select("page_id", tx.html_escape(F.col("html")).alias("escaped"))


@table_query("documents", "SELECT doc_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: len(x))), 0) + 1) AS fence FROM documents")
def fence_len(d: DataFrame) -> DataFrame:
    return d.select("doc_id", tx.fence_length(F.col("text")).cast("long").alias("fence"))


@table_query(
    "documents",
    "SELECT doc_id, CASE WHEN length(f) > 80 THEN f[1:79] || '…' ELSE f END AS line FROM (SELECT doc_id, replace(text, chr(10), ' ⏎ ') AS f FROM documents)",
)
def one_line(d: DataFrame) -> DataFrame:
    return d.select("doc_id", tx.one_line(F.col("text"), 80).alias("line"))


def _took_sql(d: str) -> str:
    return (
        f"CASE WHEN {d} IS NULL OR {d} <= 0 THEN '-' WHEN {d} < 1000 THEN {d} || 'ms' WHEN {d} < 60000 THEN printf('%.1fs', (({d} + 50) // 100) / 10.0) "
        f"WHEN {d} < 3600000 THEN printf('%dm%02ds', {d} // 60000, {d} // 1000 % 60) WHEN {d} < 86400000 THEN printf('%dh%02dm', {d} // 3600000, {d} // 60000 % 60) "
        f"ELSE ({d} // 86400000) || 'd' || ({d} // 3600000 % 24) || 'h' END"
    )


@query(f"SELECT id, {_took_sql('d')} AS took FROM (SELECT id, ({_DUR}) * (id % 2000) AS d FROM commands)")
def human_duration(c: DataFrame) -> DataFrame:
    from ..schema import duration_ms

    return c.select("id", tx.human_duration(duration_ms() * (F.col("id") % 2000)).alias("took"))


@table_query(
    "documents",
    "SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', ((n * 10 + 524288) // 1048576) / 10.0) WHEN n >= 1024 THEN printf('%.1f KB', ((n * 10 + 512) // 1024) / 10.0) ELSE n || ' B' END AS size FROM (SELECT doc_id, n_chars * 97 AS n FROM documents)",
)
def human_bytes(d: DataFrame) -> DataFrame:
    return d.select("doc_id", tx.human_bytes(F.col("n_chars") * 97).alias("size"))


@query("SELECT id, cmd, started_ms FROM commands WHERE machine IS NULL AND id > 500 ORDER BY id")
def sync_pending(c: DataFrame) -> DataFrame:
    return merge.pending(c, 500).select("id", "cmd", "started_ms")


@query("SELECT machine, max(host) AS host, max(origin_seq) AS last_seq FROM commands WHERE machine IS NOT NULL GROUP BY machine")
def sync_hwm(c: DataFrame) -> DataFrame:
    return merge.high_water(c)


@query("SELECT (SELECT count(*) FROM commands WHERE machine IS NULL AND id > 500) AS pending, (SELECT max(id) FROM commands WHERE machine IS NULL) AS max_id")
def sync_counts(c: DataFrame) -> DataFrame:
    return merge.pending_count(c, 500).crossJoin(merge.max_local_id(c))  # one row each


@query(
    ", z AS (SELECT id, CAST((sum(length(cmd) + strlen(plain) + 64) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - 1) // 1000000 AS BIGINT) AS segment FROM commands WHERE machine IS NULL) SELECT id, segment FROM z",
    slim=False,
)
def segment_roll(c: DataFrame) -> DataFrame:
    return merge.segment_numbers(c.filter("machine is null"), 1_000_000).select("id", "segment")


@table_query(
    "documents",
    "SELECT doc_id, CASE WHEN n <= 1536 THEN t ELSE t[1:512] || chr(10) || '… [' || (n - 1536) || ' bytes truncated] …' || chr(10) || t[-1024:] END AS clipped "
    "FROM (SELECT doc_id, regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') AS t, length(text) AS n FROM documents)",
)
def head_tail_clip(d: DataFrame) -> DataFrame:
    """On text made ASCII, where characters are bytes."""
    from ..streaming.capture import clip_bytes

    ascii_text = F.regexp_replace("text", "[^\\x01-\\x7f]", "?")
    return d.select("doc_id", F.decode(clip_bytes(F.encode(ascii_text, "UTF-8"), 512, 1024), "UTF-8").alias("clipped"))


@query("SELECT id, CASE exit_code WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE '? (no exit recorded)' END AS label FROM commands")
def exit_labels(c: DataFrame) -> DataFrame:
    return c.select("id", tx.exit_label(stats.group_key("exit")).alias("label"))


@query("SELECT id, '''' || replace(cmd, '''', '''\\''''') || '''' AS quoted FROM commands")
def shell_quoted(c: DataFrame) -> DataFrame:
    from ..functions.commandline import shell_quote

    return c.select("id", shell_quote(F.col("cmd")).alias("quoted"))


@query("SELECT id, regexp_full_match(cmd, '\\s*(exit(\\s+[0-9]+)?|logout)\\s*') AS leaves FROM commands")
def shell_exits(c: DataFrame) -> DataFrame:
    from ..functions.commandline import shell_exit

    return c.select("id", shell_exit(F.col("cmd")).alias("leaves"))


@query(
    "SELECT id, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(string_split(cmd, ''), lambda x: CAST(ord(x) AS UHUGEINT))), "
    "lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616) % 9223372036854775808 AS BIGINT) AS seq FROM commands"
)
def fnv_keys(c: DataFrame) -> DataFrame:
    return c.select("id", tx.fnv_seq(F.col("cmd")).alias("seq"))


@table_query("documents", "SELECT doc_id, replace(text, chr(9), ' ') AS plain FROM documents")
def strip_ansi(d: DataFrame) -> DataFrame:
    """Documents made into terminal output by rule, and stripped again."""
    from ..functions.terminal import strip_ansi as strip

    return d.select("doc_id", strip(_coloured()).alias("plain"))


#: 'the' as a word of its own, marked; twice, as a match takes the sign between two of them.
_THE = "regexp_replace({}, '(^|[^\\pL\\pN\\pM_])the([^\\pL\\pN\\pM_]|$)', '\\1' || chr(2) || '\\2', 'g')"


@table_query(
    "documents",
    f"SELECT doc_id, replace(replace(replace(replace({_THE.format(_THE.format('text'))}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(2), '<span class=\"f1\">the</span>') AS html FROM documents",
)
def ansi_html(d: DataFrame) -> DataFrame:
    from ..functions.terminal import ansi_html as render

    return d.select("doc_id", render(_coloured()).alias("html"))


def _coloured():
    """The text with each 'the' in red and lines ended as a terminal does."""
    red = F.regexp_replace("text", r"\bthe\b", "\x1b[31mthe\x1b[0m")
    return F.concat(F.lit("\x1b]0;title\x07working\r"), F.replace(red, F.lit("\n"), F.lit("\r\n")))


@query(slim=False)
def diff_unified(c: DataFrame) -> DataFrame:
    """Each failed run's output against that of the previous run of its command."""
    from ..functions.diff import unified_diff

    pairs = listing.previous_runs(c).join(c.filter("exit_code <> 0").select("id", "plain"), "id")
    old = c.select(F.col("id").alias("prev_id"), F.col("plain").alias("old"))
    return pairs.join(old, "prev_id").select("id", "prev_id", unified_diff(F.col("old"), F.col("plain")).alias("diff"))


@query(
    "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS n, cmd, exit_code, "
    "strlen(replace(coalesce(plain, ''), chr(10), chr(13) || chr(10))) AS output_bytes, "
    "strlen(replace(coalesce(plain, ''), chr(10), chr(13) || chr(10))) > 262144 + 1048576 AS truncated FROM commands WHERE session_id > 0",
    slim=False,
)
def segment_batch(c: DataFrame) -> DataFrame:
    """The sessions' terminal streams, made from the commands by rule, cut into commands again."""
    from ..streaming.jobs import segment_batch as segment

    text = F.concat(
        F.lit("\x1b]6973;cmd="), F.base64(F.encode("cmd", "UTF-8")), F.lit("\x07\x1b]133;C\x07"), F.replace(F.coalesce("plain", F.lit("")), F.lit("\n"), F.lit("\r\n")),
        F.lit("\x1b]133;D;"), F.coalesce(F.col("exit_code").cast("string"), F.lit("")), F.lit("\x07"),
    )
    own = c.filter("session_id > 0").select("session_id", F.col("id").alias("seq"), F.timestamp_millis("started_ms").alias("ts"), F.encode(text, "UTF-8").alias("data"))
    return segment(own).select("session_id", "n", "cmd", "exit_code", "output_bytes", "truncated")


_TEXT = "coalesce(plain, '')"


def _exported() -> str:
    """The newest twenty rows with secrets masked, and what their line of facts says."""
    return (
        f", x AS (SELECT * REPLACE ({_redact_sql('cmd')} AS cmd, {_redact_sql(_TEXT)} AS plain) FROM commands {NEWEST} LIMIT 20), "
        f"y AS (SELECT *, {_DUR} AS d FROM x), "
        "z AS (SELECT *, concat_ws(' · ', CASE WHEN started_ms > 0 THEN strftime(make_timestamp(started_ms * 1000), '%Y-%m-%d %H:%M:%S') ELSE 'time unknown' END, "
        f"nullif(cwd, ''), 'exit ' || exit_code, CASE WHEN d >= 0 THEN {_took_sql('d')} END) AS meta FROM y) "
    )


def _escaped_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_ISO = "CASE WHEN {0} > 0 THEN strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END"


@query(
    _exported().rstrip() + ", f AS (SELECT *, '$ ' || cmd || chr(10) || plain AS t FROM z), "
    "g AS (SELECT *, repeat('`', CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda r: length(r))), 0) + 1) AS INT)) AS fence FROM f) "
    f"SELECT id, started_ms, fence || 'console' || chr(10) || rtrim(t, chr(10)) || chr(10) || fence || chr(10) || '<sub>' || {_escaped_sql('meta')} || '</sub>' || chr(10) AS body FROM g",
    slim=False,
)
def export_markdown(c: DataFrame) -> DataFrame:
    from ..sinks import export

    rows = export.prepared(listing.newest_then_oldest_first(c), redacted=True)
    return export.markdown(rows).orderBy("started_ms", "id")


@query(
    _exported() + "SELECT id, started_ms, CAST(to_json({'id': id, 'cmd': cmd, 'cwd': coalesce(cwd, ''), 'exit': exit_code, "
    f"'started_at': {_ISO.format('started_ms')}, 'ended_at': {_ISO.format('ended_ms')}, 'duration_ms': d, 'output': plain}}) AS VARCHAR) AS body FROM z",
    slim=False,
)
def export_json(c: DataFrame) -> DataFrame:
    from ..sinks import export

    return export.json_rows(export.prepared(listing.newest_then_oldest_first(c), redacted=True))


@query(
    _exported() + "SELECT '<!doctype html><html><head><meta charset=utf-8><title>Commands</title><style>pre{white-space:pre-wrap}.bo{font-weight:bold}.di{opacity:.6}.it{font-style:italic}</style></head><body>' "
    f"|| chr(10) || string_agg('<section><h2><code>' || {_escaped_sql('cmd')} || '</code></h2><p>' || {_escaped_sql('meta')} || '</p><pre>' || {_escaped_sql('plain')} || '</pre></section>' || chr(10), '' "
    "ORDER BY started_ms, id) || '</body></html>' || chr(10) AS document FROM z",
    slim=False,
)
def export_html(c: DataFrame) -> DataFrame:
    from ..sinks import export

    return export.html_page(export.prepared(listing.newest_then_oldest_first(c), redacted=True))


@query(
    _exported().rstrip() + ", c AS (SELECT id, started_ms, cmd, string_split(CASE WHEN ends_with(plain, chr(10)) THEN left(plain, length(plain) - 1) ELSE plain END, chr(10)) AS l FROM z), "
    # A prompt 600 ms before the output, a line each 15 ms, and a pause of 800 ms.
    "t AS (SELECT *, coalesce(sum(1400 + 15 * len(l)) OVER (ORDER BY started_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c), "
    "k AS (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM t), "
    "e AS (SELECT started_ms, id, 0 AS k, start AS ms, '$ ' || cmd AS s FROM t UNION ALL SELECT started_ms, id, k, start + 600 + 15 * (k - 1), l[k] FROM k) "
    "SELECT '{\"version\": 2, \"width\": 100, \"height\": 30}' || chr(10) || string_agg('[' || CAST(CAST(ms AS BIGINT) / 1000 AS VARCHAR) || ', \"o\", ' || "
    "CAST(to_json(s || chr(13) || chr(10)) AS VARCHAR) || ']' || chr(10), '' ORDER BY started_ms, id, k) AS document FROM e",
    slim=False,
)
def export_cast(c: DataFrame) -> DataFrame:
    from ..sinks import export

    return export.asciicast(export.prepared(listing.newest_then_oldest_first(c), redacted=True))


@query(
    "SELECT id, started_ms, id || chr(9) || CASE WHEN exit_code IS NULL THEN '?' WHEN exit_code = 0 THEN ' ' ELSE '!' END || ' ' || replace(cmd, chr(10), ' ⏎ ') AS line "
    f"FROM commands {NEWEST} LIMIT 1000"
)
def picker_feed(c: DataFrame) -> DataFrame:
    return listing.picker_feed(c)


@query(
    f", b AS ({_breakdown_sql('exit')} ORDER BY count DESC, key LIMIT 15) SELECT key, rpad(key, 32, ' ') || ' ' || lpad(CAST(count AS VARCHAR), 8, ' ') || '  ' || lpad(fail_pct || '%', 5, ' ') "
    f"|| '  ' || lpad({_took_sql('dur_ms')}, 8, ' ') || '  ' || repeat('█', CAST(greatest(1, count * 30 // (SELECT max(count) FROM b)) AS INT)) AS line FROM b"
)
def stats_table(c: DataFrame) -> DataFrame:
    from ..sinks import export

    return export.stats_table(stats.breakdown(c, "exit", 15))


@table_query(
    "events",
    "WITH s AS (SELECT 'm' || (user_id % 5) AS machine, 'h' || (user_id % 5) AS host, event_id % 1000 AS bytes, event_id AS seq FROM events), "
    "k AS (SELECT machine, max(seq) AS last_seq FROM s WHERE machine < 'm3' GROUP BY machine) "
    "SELECT s.machine, host, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes, coalesce(max(last_seq), 0) AS last_seq, s.machine = 'm2' AS local "
    "FROM s LEFT JOIN k ON s.machine = k.machine GROUP BY s.machine, host",
)
def sync_status(e: DataFrame) -> DataFrame:
    n = (F.col("user_id") % 5).cast("string")
    segments = e.select(F.concat(F.lit("m"), n).alias("machine"), F.concat(F.lit("h"), n).alias("host"), (F.col("event_id") % 1000).alias("bytes"), "event_id")
    state = segments.filter("machine < 'm3'").groupBy("machine").agg(F.max("event_id").alias("last_seq"))
    return merge.sync_status(segments.drop("event_id"), state, "m2")


@query("SELECT id, cmd FROM commands WHERE machine IS NULL AND id > 100 AND NOT regexp_matches(cmd, '^ls')")
def export_pending(c: DataFrame) -> DataFrame:
    return merge.export_rows(c, 100, ["^ls"]).select("id", "cmd")


from . import records  # noqa: E402, F401 (registers its queries)
