"""Exports: Markdown, asciicast, JSON, HTML pages, terminal tables, API and tool text.

Each row is rendered by an expression or an Arrow UDF; a document is the ordered
aggregate of its rows, which a limit keeps few.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redact import redact
from ..functions.terminal import ansi_html, strip_ansi
from ..functions.text import fence_length, html_escape, human_duration, when
from ..schema import duration_ms

CAST_WIDTH, CAST_HEIGHT = 100, 30
BAR_WIDTH = 30


def _meta() -> Column:
    """Time, directory, exit and duration, as far as they are known."""
    took = F.when(duration_ms() >= 0, human_duration(duration_ms()))
    code = F.when(F.col("exit_code").isNotNull(), F.concat(F.lit("exit "), F.col("exit_code").cast("string")))
    return F.concat_ws(" · ", when(F.col("started_ms")), F.nullif("cwd", F.lit("")), code, took)


def prepared(commands: DataFrame, redacted: bool = False) -> DataFrame:
    """Escapes stripped, then secrets masked: never the other way round."""
    rows = commands.withColumn("plain", strip_ansi(F.coalesce("plain", F.lit(""))))
    return rows.withColumns({c: redact(F.col(c)) for c in ("cmd", "plain")}) if redacted else rows


def markdown(commands: DataFrame, details: bool = False) -> DataFrame:
    """(id, started_ms, body): a section per command, its output in a fence long enough."""
    text = F.concat(F.lit("$ "), F.col("cmd"), F.lit("\n"), F.col("plain"))
    fence = F.repeat(F.lit("`"), fence_length(text))
    block = F.concat(fence, F.lit("console\n"), F.rtrim(text, F.lit("\n")), F.lit("\n"), fence, F.lit("\n"))
    if details:
        body = F.concat(F.lit("<details><summary><code>"), html_escape(F.col("cmd")), F.lit("</code></summary>\n\n"), block, F.lit("\n</details>\n"))
    else:
        body = F.concat(block, F.lit("<sub>"), html_escape(_meta()), F.lit("</sub>\n"))
    return commands.select("id", "started_ms", body.alias("body"))


def json_rows(commands: DataFrame) -> DataFrame:
    """(id, started_ms, body): RFC 3339 times; durations are null where the end is unknown."""
    iso = lambda c: F.when(F.col(c) > 0, F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    row = F.struct(
        "id", "cmd", F.coalesce("cwd", F.lit("")).alias("cwd"), F.col("exit_code").alias("exit"), iso("started_ms").alias("started_at"),
        iso("ended_ms").alias("ended_at"), duration_ms().alias("duration_ms"), F.col("plain").alias("output"),
    )
    return commands.select("id", "started_ms", F.to_json(row, {"ignoreNullFields": "false"}).alias("body"))


def html_rows(commands: DataFrame, raw: str = "plain") -> DataFrame:
    """(id, started_ms, body): a section of a page, colours kept."""
    body = F.concat(
        F.lit("<section><h2><code>"), html_escape(F.col("cmd")), F.lit("</code></h2><p>"), html_escape(_meta()), F.lit("</p><pre>"),
        ansi_html(F.col(raw)), F.lit("</pre></section>\n"),
    )
    return commands.select("id", "started_ms", body.alias("body"))


def document(rows: DataFrame, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """One row: the bodies, oldest first, in one text. For exports, which are limited."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("started_ms", "id", "body"))), lambda r: r["body"])
    return rows.agg(F.concat(F.lit(head), F.array_join(ordered, between), F.lit(tail)).alias("document"))


PAGE_HEAD = "<!doctype html><html><head><meta charset=utf-8><title>Commands</title><style>pre{white-space:pre-wrap}.bo{font-weight:bold}.di{opacity:.6}.it{font-style:italic}</style></head><body>\n"
PAGE_TAIL = "</body></html>\n"


def html_page(commands: DataFrame) -> DataFrame:
    return document(html_rows(commands), PAGE_HEAD, PAGE_TAIL, "")


def json_array(commands: DataFrame) -> DataFrame:
    return document(json_rows(commands), "[", "]", ",\n ")


def cast_lines(cmd: str, output: str, at: float) -> tuple[list[str], float]:
    """Events of one command, and the time after it: the prompt, each line, a pause."""
    events = [(at, f"$ {cmd}\r\n")]
    at += 0.6
    for line in output.split("\n")[: -1 if output.endswith("\n") else None]:
        events.append((at, line + "\r\n"))
        at += 0.015
    return [json.dumps([round(t, 3), "o", s], ensure_ascii=False) for t, s in events], at + 0.8


def asciicast(commands: DataFrame) -> DataFrame:
    """One row: a version 2 recording of the commands, oldest first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["started_ms", "id"])
        out = [json.dumps({"version": 2, "width": CAST_WIDTH, "height": CAST_HEIGHT})]
        at = 0.0
        for cmd, text in zip(rows["cmd"], rows["plain"], strict=True):
            lines, at = cast_lines(cmd, text or "", at)
            out += lines
        return pd.DataFrame({"document": ["\n".join(out) + "\n"]})

    return commands.select("id", "started_ms", "cmd", "plain", F.lit(1).alias("g")).groupBy("g").applyInPandas(run, T.StructType([T.StructField("document", T.StringType())]))


def bar(count: Column, top: Column) -> Column:
    return F.repeat(F.lit("█"), F.greatest(F.lit(1), F.floor(count * BAR_WIDTH / top)).cast("int"))


def stats_table(groups: DataFrame) -> DataFrame:
    """Formatted lines of a breakdown (key, count, fails, dur_ms, fail_pct); for top-N results."""
    share = F.when(F.col("count") == 0, "-").otherwise(F.concat(F.col("fail_pct").cast("string"), F.lit("%")))
    top = groups.agg(F.max("count").alias("top"))
    line = F.format_string("%-32s %8d  %5s  %8s  %s", "key", "count", share, human_duration(F.col("dur_ms")), bar(F.col("count"), F.col("top")))
    return groups.crossJoin(F.broadcast(top)).select("key", line.alias("line"))  # one row: the largest count


def tool_text(rows: DataFrame) -> DataFrame:
    """A line per command as the tools print them: id, time, exit, directory, command; secrets masked."""
    code = F.coalesce(F.col("exit_code").cast("string"), F.lit("?"))
    line = F.format_string("#%d %s [%s] %s $ %s", F.col("id"), when(F.col("started_ms")), code, F.coalesce("cwd", F.lit("")), redact(F.col("cmd")))
    return rows.select("id", "started_ms", line.alias("line"))
