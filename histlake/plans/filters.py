"""The shared filter of all verbs, its three front ends, and time and size specs.

Relative times become literals on the driver, so predicates stay foldable and
reach the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, replace
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import failed

DEFAULT_LIMIT = 20
#: Row limits by verb; the web's are (default, most), values outside are ignored.
LIMITS = {"list": 20, "search": 20, "pick": 1000, "export": 20, "web": (50, 500), "tool": 100, "stats": 15, "web_stats": (15, 100)}


class FilterError(ValueError):
    """A filter value that cannot be read."""


@dataclass(frozen=True)
class Filter:
    """AND-ed predicates; ``limit`` <= 0 means the default of 20 and is no predicate.

    Directory prefixes are compared case-sensitively, and ``/`` holds everything.
    """

    session: int = 0
    cwd: str = ""
    exit_code: int | None = None
    failed: bool = False
    since_ms: int | None = None
    until_ms: int | None = None
    host: str = ""
    limit: int = 0

    def active(self) -> bool:
        """Whether any predicate is set; a limit alone is none."""
        return replace(self, limit=0) != Filter()

    def rows(self) -> int:
        return self.limit if self.limit > 0 else DEFAULT_LIMIT

    def predicates(self) -> list[Column]:
        out = []
        if self.session > 0:
            out.append(F.col("session_id") == self.session)
        if self.cwd and (p := self.cwd.rstrip("/")):
            out.append((F.col("cwd") == p) | F.col("cwd").startswith(p + "/"))
        if self.exit_code is not None:
            out.append(F.col("exit_code") == self.exit_code)
        elif self.failed:
            out.append(failed())
        if self.since_ms is not None:
            out.append(F.col("started_ms") >= self.since_ms)
        if self.until_ms is not None:
            out.append(F.col("started_ms") < self.until_ms)
        if self.host == "local":
            out.append(F.col("machine").isNull())
        elif self.host:
            out.append(F.col("host") == self.host)
        return out

    def apply(self, commands: DataFrame) -> DataFrame:
        return reduce(DataFrame.filter, self.predicates(), commands)


_GO_DURATION = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")
_UNIT_MS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}


def duration_ms(text: str) -> float:
    """A duration such as 1h30m, in milliseconds; raises FilterError."""
    sign, rest = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    if rest == "0":
        return 0.0
    parts = _GO_DURATION.findall(rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        raise FilterError(f"not a duration: {text!r}")
    return sign * sum(float(a) * _UNIT_MS[b] for a, b in parts)


def time_spec(text: str, now_ms: int, zone: str = "UTC") -> int:
    """A point in time, in epoch milliseconds: absolute (date, with or without minutes) or how long ago."""
    for form in ("%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
        try:
            return int(dt.datetime.strptime(text, form).replace(tzinfo=ZoneInfo(zone)).timestamp() * 1000)
        except ValueError:
            pass
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)([dw])", text):
        ago = float(m[1]) * 86_400_000 * (7 if m[2] == "w" else 1)
    else:
        ago = duration_ms(text)
    if ago < 0:
        raise FilterError(f"not a time: {text!r}")
    return int(now_ms - ago)


def prune_age_ms(text: str) -> int:
    """An age: whole days, or a duration; weeks are not known here."""
    if m := re.fullmatch(r"(\d+)d", text):
        return int(m[1]) * 86_400_000
    return int(duration_ms(text))


_SIZE = re.compile(r"(\d+(?:\.\d*)?|\.\d+)\s*([kmgt]?)i?b?", re.I)


def parse_size(text: str) -> int:
    """A size with a binary unit K, M, G or T, which B or iB may follow."""
    m = _SIZE.fullmatch(text.strip())
    if not m:
        raise FilterError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2].lower() or " "))


def from_flags(flags: dict[str, str], now_ms: int, zone: str = "UTC", here: str = "/") -> Filter:
    """Command-line flags; bad values raise, a relative directory is made absolute."""
    exit_text = flags.get("exit")
    try:
        return Filter(
            session=int(flags.get("session", 0)), cwd=_absolute(flags.get("cwd", ""), here), exit_code=None if exit_text is None else int(exit_text),
            failed=flags.get("failed", "") in ("1", "true"), host=flags.get("host", ""), limit=int(flags.get("limit", 0)),
            since_ms=time_spec(flags["since"], now_ms, zone) if flags.get("since") else None,
            until_ms=time_spec(flags["until"], now_ms, zone) if flags.get("until") else None,
        )
    except ValueError as e:
        raise FilterError(str(e)) from e


def from_params(params: dict[str, str], now_ms: int, zone: str = "UTC", limits: str = "web") -> Filter:
    """URL parameters; a value that cannot be read is ignored, a directory is taken as given."""

    def read(name: str, parse):
        try:
            return parse(params[name]) if params.get(name) else None
        except ValueError:
            return None

    default, most = LIMITS[limits]
    limit = read("limit", int)
    return Filter(
        session=read("session", int) or 0, cwd=params.get("cwd", ""), exit_code=read("exit", int), failed=params.get("failed") in ("1", "true"),
        since_ms=read("since", lambda t: time_spec(t, now_ms, zone)), until_ms=read("until", lambda t: time_spec(t, now_ms, zone)),
        host=params.get("host", ""), limit=limit if limit is not None and 1 <= limit <= most else default,
    )


def from_arguments(given: dict, now_ms: int, zone: str = "UTC", here: str = "/") -> Filter:
    """Tool arguments (JSON); bad values raise, the limit is clamped."""
    flags = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in given.items() if v is not None}
    found = from_flags(flags, now_ms, zone, here)
    return replace(found, limit=min(found.rows(), LIMITS["tool"]))


def _absolute(path: str, here: str) -> str:
    if not path or path.startswith("/"):
        return path
    parts = [p for p in f"{here}/{path}".split("/") if p not in ("", ".")]
    out: list[str] = []
    for p in parts:
        out = out[:-1] if p == ".." else [*out, p]
    return "/" + "/".join(out)


def split_flags(words: list[str], switches: frozenset[str] = frozenset({"failed"})) -> tuple[dict[str, str], list[str]]:
    """Flags (--name value, --name=value) and query words, in any order; -- ends the flags."""
    flags, rest = {}, []
    it = iter(words)
    for w in it:
        if w == "--":
            rest += it
        elif w.startswith("-") and len(w) > 1:
            name, eq, value = w.lstrip("-").partition("=")
            flags[name] = value if eq else "true" if name in switches else next(it, "")
        else:
            rest.append(w)
    return flags, rest
