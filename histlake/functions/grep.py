"""Grep context over one text: the plain form, for verbs that already hold few rows, and as a test oracle."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Hunk:
    start: int
    lines: list[str]
    is_match: list[bool]


def context(text: str, query: str, before: int, after: int, most: int = 5) -> tuple[list[Hunk], int, int]:
    """(hunks, matching lines in all, matching lines within the hunks returned)."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    hit = [query.lower() in x.lower() for x in lines]
    keep = [any(hit[max(0, i - after) : i + before + 1]) for i in range(len(lines))]
    hunks: list[Hunk] = []
    for i, line in enumerate(lines):
        if keep[i]:
            if not i or not keep[i - 1]:
                hunks.append(Hunk(i, [], []))
            hunks[-1].lines.append(line)
            hunks[-1].is_match.append(hit[i])
    shown = hunks[:most]
    return shown, sum(hit), sum(sum(h.is_match) for h in shown)
