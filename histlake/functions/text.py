"""Text and number formatting as JVM expressions, and the few scalars that need Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_line(text: Column, most: int) -> Column:
    """Line feeds become a sign; cut to ``most`` characters, the last an ellipsis."""
    flat = F.replace(text, F.lit("\n"), F.lit(" ⏎ "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def html_escape(text: Column) -> Column:
    """&, < and >; quotes stay."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fence_length(text: Column) -> Column:
    """Backticks of a fence around the text: one more than its longest run, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), 0), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def strip_space(text: Column) -> Column:
    return F.translate(text, " \t\n\r", "")


def _tenths(n: Column, unit: int) -> Column:
    """n / unit to one decimal, half up, in integers: the same on every engine."""
    return F.floor((n * 10 + unit // 2) / unit).cast("double") / 10


def human_bytes(n: Column) -> Column:
    """B, KB or MB, by 1024."""
    return (
        F.when(n >= 1 << 20, F.format_string("%.1f MB", _tenths(n, 1 << 20)))
        .when(n >= 1 << 10, F.format_string("%.1f KB", _tenths(n, 1 << 10)))
        .otherwise(F.format_string("%d B", n))
    )


def human_duration(ms: Column) -> Column:
    """250ms, 4.2s, 3m41s, 1h12m, 2d3h; - for none."""
    s = F.floor(ms / 1000)
    pair = lambda form, big, small, base: F.format_string(form, F.floor(s / big), F.floor(s / small) % base)
    return (
        F.when(ms.isNull() | (ms <= 0), "-")
        .when(ms < 1000, F.format_string("%dms", ms))
        .when(ms < 60_000, F.format_string("%.1fs", _tenths(ms, 1000)))
        .when(ms < 3_600_000, pair("%dm%02ds", 60, 1, 60))
        .when(ms < 86_400_000, pair("%dh%02dm", 3600, 60, 60))
        .otherwise(pair("%dd%dh", 86_400, 3600, 24))
    )


def short_duration(started: Column, ended: Column) -> Column:
    """The span, or nothing if either end is unknown or they are reversed."""
    return F.when((started > 0) & ended.isNotNull() & (ended >= started), human_duration(ended - started)).otherwise("")


def ago(started: Column, now_ms: int) -> Column:
    """just now, minutes or hours before ``now_ms``, else the date; ``time unknown`` for 0."""
    gone = F.lit(now_ms) - started
    return (
        F.when(started <= 0, "time unknown").when(gone < 60_000, "just now")
        .when(gone < 3_600_000, F.format_string("%dm ago", F.floor(gone / 60_000)))
        .when(gone < 86_400_000, F.format_string("%dh ago", F.floor(gone / 3_600_000)))
        .otherwise(F.date_format(F.timestamp_millis(started), "MMM dd HH:mm"))
    )


def when(started: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.when(started > 0, F.date_format(F.timestamp_millis(started), form)).otherwise("time unknown")


# Names of the exit codes 128 + n.
SIGNALS = {129: "SIGHUP", 130: "SIGINT", 131: "SIGQUIT", 134: "SIGABRT", 137: "SIGKILL", 139: "SIGSEGV", 141: "SIGPIPE", 143: "SIGTERM"}


def exit_label(key: Column) -> Column:
    """An exit key as shown: signals named, ? explained."""
    names = F.create_map(*[F.lit(x) for k, v in SIGNALS.items() for x in (str(k), v)])
    named = F.concat(key, F.lit(" ("), F.element_at(names, key), F.lit(")"))
    return F.when(key == "?", "? (no exit recorded)").otherwise(F.coalesce(named, key))


def next_day(day: Column) -> Column:
    """The calendar day after a yyyy-MM-dd; null for anything else, as the key of unknown times is."""
    return F.date_add(F.try_to_date(day, "yyyy-MM-dd"), 1).cast("string")


def home_label(path: Column, home: str) -> Column:
    """The home directory and what is below it, shortened to ~."""
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 20))).otherwise(path)


def host_tag(host: Column) -> Column:
    return F.when(F.coalesce(host, F.lit("")) == "", "").otherwise(F.concat(F.lit("@"), host))


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv_sequence(cmd: str) -> int:
    """FNV-1a of the UTF-8 bytes, 64 bits, the sign bit cleared."""
    h = FNV_OFFSET
    for b in cmd.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h & 0x7FFFFFFFFFFFFFFF


@F.pandas_udf(T.LongType())
def fnv_seq(cmd: pd.Series) -> pd.Series:
    return cmd.map(lambda c: None if c is None else fnv_sequence(c))




def percent_decode(text: str) -> str:
    """%XX decoded; malformed ones and + stay."""
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode("utf-8", "replace")


def vsc_unescape(text: str) -> str:
    r"""\\ and \xHH decoded; other escapes stay."""
    found = re.sub(rb"\\(?:\\|x([0-9A-Fa-f]{2}))", lambda m: bytes([int(m[1], 16)]) if m[1] else b"\\", text.encode())
    return found.decode("utf-8", "replace")


def windows_path(path: str) -> str:
    """/C:/x as C:\\x; other paths as they are."""
    return path[1:].replace("/", "\\") if re.match(r"/[A-Za-z]:", path) else path


def osc7_path(url: str) -> str:
    """The path of a directory URL: scheme and host dropped, escapes decoded."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/]*", url)
    return windows_path(percent_decode(url[m.end() :])) if m else ""


@F.pandas_udf(T.StringType())
def decode_percent(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else percent_decode(t))


@F.pandas_udf(T.StringType())
def decode_vsc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else vsc_unescape(t))
