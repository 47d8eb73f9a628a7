"""Marking matches in text: highlights, snippets, clipped lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON, OFF = "\x01", "\x02"
SNIPPET_TOKENS = 12


def places(text: str, query: str) -> list[int]:
    """Starts of the query in the text, left to right, not overlapping, case aside.

    If lower case changes the length of the text, case counts.
    """
    low, q = text.lower(), query.lower()
    if len(low.encode()) != len(text.encode()) or len(low) != len(text):
        low, q = text, query
    out, at = [], low.find(q) if q else -1
    while at >= 0:
        out.append(at)
        at = low.find(q, at + len(q))
    return out


def mark(text: str, query: str, on: str = ON, off: str = OFF) -> str:
    out, last = [], 0
    for a in places(text, query):
        out += [text[last:a], on, text[a : a + len(query)], off]
        last = a + len(query)
    return "".join([*out, text[last:]])


def match_offset(line: str, query: str) -> int:
    """Byte offset of the first match, 0 if there is none."""
    found = places(line, query)
    return len(line[: found[0]].encode()) if found else 0


def rune_floor(data: bytes, at: int) -> int:
    """The last character boundary at or before a byte."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return max(0, min(at, len(data)))


def clip_line(line: str, query: str, width: int) -> str:
    """The line cut to about ``width`` bytes around its first match, which stays in view; ellipses where it is cut."""
    data = line.encode()
    if len(data) <= width:
        return line
    at = match_offset(line, query)
    start = rune_floor(data, at - 30) if at > width - 30 else 0
    end = rune_floor(data, start + width)
    return ("…" if start else "") + data[start:end].decode() + ("…" if end < len(data) else "")


def snippet_of(text: str, query: str) -> str:
    """About 12 trigram tokens around the first match, marked; ellipses where the text is cut.

    Without a match in the text (the command matched) its beginning.
    """
    at = text.lower().find(query.lower())
    tokens = max(0, len(text) - 2)
    own = max(1, len(query) - 2)
    start = 0 if at < 0 else min(max(0, at - max(0, (SNIPPET_TOKENS - own) // 2)), max(0, tokens - SNIPPET_TOKENS))
    end = min(len(text), start + SNIPPET_TOKENS + 2)
    return ("…" if start else "") + mark(text[start:end], query) + ("…" if end < len(text) else "")


@F.pandas_udf(T.StringType())
def highlight(text: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else mark(t, q) for t, q in zip(text, query, strict=True)])


@F.pandas_udf(T.StringType())
def snippet(text: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([snippet_of(t or "", q) for t, q in zip(text, query, strict=True)])


def merge_ranges(ranges: list[tuple[int, int]], most: int = 2000) -> list[tuple[int, int]]:
    """Overlapping or touching highlight ranges joined; at most ``most`` of them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        elif len(out) < most:
            out.append((a, b))
    return out


def query_terms(query: str) -> list[str]:
    """Words to highlight, longest first; operators are none."""
    return sorted({w for w in query.split() if w not in ("AND", "OR", "NOT", "NEAR")}, key=lambda w: (-len(w), w))
