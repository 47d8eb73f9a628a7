"""The read-only API and the tool calls: plans that return few rows, as dicts or text.

Everything shown is stripped of escapes and then masked; matching runs on the
masked text, so a highlight never splits a secret.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff, grep
from ..functions.highlight import OFF, ON, clip_line
from ..functions.redact import redact
from ..functions.terminal import strip_ansi
from ..functions.text import when
from ..operators import listing, search, stats
from ..plans.filters import Filter

CONTEXT_MOST = 10
LINE_WIDTH = 200


class NotFound(LookupError):
    """No such command."""


def _shown(rows: DataFrame, extra: list[str] | None) -> DataFrame:
    text = strip_ansi(F.coalesce("plain", F.lit("")))
    return rows.withColumns({"plain": redact(text, extra), "cmd": redact(F.col("cmd"), extra), "note": redact(F.coalesce("note", F.lit("")), extra), "when": when(F.col("started_ms"))})


def web_commands(commands: DataFrame, where: Filter) -> list[dict]:
    rows = where.apply(commands).orderBy(*listing.newest()).limit(where.rows())
    return [r.asDict() for r in listing.web_row(rows).collect()]


def web_breakdown(commands: DataFrame, dimension: str, where: Filter, extra: list[str] | None = None) -> list[dict]:
    """Groups with histogram, sparkline and a key to drill down by ('' where none can)."""
    own = where.apply(commands)
    groups = stats.breakdown(own, dimension, where.rows()).join(stats.activity(own, dimension), "key", "left")
    shown = groups.withColumns({"line": stats.sparkline(F.col("spark")), "masked": redact(F.col("key"), extra)})
    return [r.asDict() | {"raw": drill_key(dimension, r["key"], r["masked"])} for r in shown.collect()]


def drill_key(dimension: str, key: str, masked: str) -> str:
    """The filter value of a group's key, or ''."""
    if dimension == "session":
        return key[1:] if re.fullmatch(r"#[0-9]+", key) else ""
    wanted = {"cwd": "", "host": "", "exit": r"-?[0-9]+", "day": r"\d{4}-\d\d-\d\d"}
    if dimension not in wanted or (wanted[dimension] and not re.fullmatch(wanted[dimension], key)):
        return ""
    return key if key == masked else ""


def snippet_html(snippet: str, masked: str) -> str:
    """A marked snippet as HTML; where masking changed it, the masked text without marks."""
    plain = snippet.replace(ON, "").replace(OFF, "")
    shown = snippet if masked == plain else masked
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (ON, "<mark>"), (OFF, "</mark>")):
        shown = shown.replace(a, b)
    return shown


def span_note(commands: DataFrame) -> str:
    """The days the activity covers."""
    r = stats.time_range(commands).select(*[F.date_format(F.timestamp_millis(c), "yyyy-MM-dd").alias(c) for c in ("first", "last")]).first()
    if r["first"] is None:
        return ""
    return f", activity on {r['first']}" if r["first"] == r["last"] else f", activity {r['first']} → {r['last']}"


def headline(r) -> str:
    code = "?" if r["exit_code"] is None else r["exit_code"]
    note = f"\n    note: {r['note']}" if r["note"] else ""
    return f"#{r['id']} $ {r['cmd']}  ({r['when']}, exit {code})" + (f" in {r['cwd']}" if r["cwd"] else "") + note


def tool_list(commands: DataFrame, where: Filter, extra: list[str] | None = None) -> str:
    rows = _shown(where.apply(commands).orderBy(*listing.newest()).limit(where.rows()), extra).drop("plain").collect()
    return f"{len(rows)} command(s), most recent first:\n\n" + "\n\n".join(map(headline, rows))


def tool_search(commands: DataFrame, query: str, where: Filter, context: int = -1, extra: list[str] | None = None) -> str:
    if not query.strip():
        raise ValueError("query is required")
    hit = commands.filter(search.text_hit(query) | search.note_hit(query))
    rows = _shown(where.apply(hit).orderBy(*listing.newest()).limit(where.rows()), extra).orderBy(*listing.newest()).collect()
    if not rows:
        return f"no recorded commands matched {query!r}"
    parts = []
    for r in rows:
        lines = [headline(r)]
        hunks, _, _ = grep.context(r["plain"], query, *[max(0, min(context, CONTEXT_MOST))] * 2)
        for k, h in enumerate(hunks if context >= 0 else hunks[:1]):
            lines += ["    --"] * bool(k)
            lines += [f"    {h.start + i + 1}{':' if m else '-'} {clip_line(x, query, LINE_WIDTH)}" for i, (x, m) in enumerate(zip(h.lines, h.is_match, strict=True))]
        parts.append("\n".join(lines))
    return f"{len(rows)} match(es), most recent first:\n\n" + "\n\n".join(parts)


def _one(commands: DataFrame, n: int, extra: list[str] | None):
    if (r := _shown(listing.get(commands, n), extra).first()) is None:
        raise NotFound(n)
    return r


def tool_get(commands: DataFrame, n: int, most: int = 50 * 1024, extra: list[str] | None = None) -> str:
    r = _one(commands, n, extra)
    return headline(r) + "\n---\n" + diff.clip(r["plain"], most)


def tool_diff(commands: DataFrame, n: int, other: int | None = None, context: int = 3, extra: list[str] | None = None) -> str:
    newer = _one(commands, n, extra)
    if other is not None:
        older = _one(commands, other, extra)
    elif (older := _shown(listing.previous_run(commands, newer["id"]), extra).first()) is None:
        raise NotFound(f"no previous run of {newer['cmd']!r}")
    body = diff.unified(older["plain"], newer["plain"], context)
    if not body:
        return f"outputs of #{older['id']} and #{newer['id']} are identical"
    return f"--- {headline(older)}\n+++ {headline(newer)}\n{body}"[: diff.DIFF_CAP]
