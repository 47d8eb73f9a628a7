"""The command line typed at a prompt, recovered from its echo.

The echoed bytes are replayed on a small grid of cells, addressed by row and
column from the prompt. A cell remembers who wrote it, the prompt or the user;
only the user's cells are read back. What cannot be placed relative to the
prompt gives nothing: no text is better than a wrong one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ECHO_CAP = 32 * 1024
MOST_ROWS = 512
WIDTH = 80
PROMPT, INPUT = "p", "i"
#: Spliced into the echo where a phase begins; no terminal shows an APC string.
PROMPT_MARK, INPUT_MARK = b"\x1b_hl:P\x1b\\", b"\x1b_hl:B\x1b\\"

_TOKEN = re.compile(
    r"\x1b\[(?P<params>[^\x40-\x7e]*)(?P<final>[\x40-\x7e])|\x1b\](?:[^\x07\x1b]|\x1b(?!\\))*(?:\x07|\x1b\\)|\x1b[PX^_](?P<string>(?:[^\x07\x1b]|\x1b(?!\\))*)(?:\x07|\x1b\\)"
    r"|\x1b[()*+].|\x1b(?P<single>[^\[\]PX^_()*+])|(?P<control>[\x00-\x1f\x7f])|(?P<text>[^\x00-\x1f\x7f]+)", re.S
)


@dataclass
class Grid:
    """Sparse rows of (character, phase) cells; ``joined`` rows continue the one above after an automatic wrap."""

    width: int
    rows: list[dict[int, tuple[str, str]]] = field(default_factory=lambda: [{}])
    joined: set[int] = field(default_factory=set)
    at: tuple[int, int] = (0, 0)
    saved: tuple[int, int] = (0, 0)
    phase: str = INPUT
    frozen: bool = False
    lost: bool = False
    last_two: str = ""
    fed_after: bool = False
    killed: bool = False

    def row(self, r: int) -> dict[int, tuple[str, str]]:
        while r >= len(self.rows):
            if len(self.rows) >= MOST_ROWS:
                self.lost = True
                return {}
            self.rows.append({})
        return self.rows[r]

    def write(self, text: str) -> None:
        r, c = self.at
        for ch in text:
            if c >= self.width:
                r, c = r + 1, 0
                self.row(r)
                self.joined.add(r)
            self.row(r)[c] = ch, self.phase
            c += 1
        self.at = r, c
        if self.phase == INPUT:
            self.last_two = (self.last_two + text)[-2:]
            self.fed_after = False

    def move(self, r: int, c: int) -> None:
        self.at = max(0, r), max(0, min(c, self.width))
        self.row(self.at[0])

    def clear(self, r: int, a: int, b: int) -> None:
        own = self.row(r)
        for c in [c for c in own if a <= c < b]:
            del own[c]

    def shift(self, by: int) -> None:
        """The cells from the cursor on, moved right, or left over those before them."""
        r, c = self.at
        own = self.row(r)
        kept = {k: v for k, v in own.items() if k < c}
        moved = {k + by: v for k, v in own.items() if k >= c and c <= k + by < self.width}
        self.rows[r] = kept | moved
        if by > 0:
            self.rows[r] |= {k: (" ", self.phase) for k in range(c, min(c + by, self.width))}

    def control(self, ch: str) -> None:
        r, c = self.at
        if ch == "\r":
            self.at = r, 0
        elif ch == "\n":
            self.move(r + 1, c)
            self.fed_after = True
        elif ch == "\b":
            self.at = r, max(0, min(c, self.width) - 1)
        elif ch == "\t":
            self.at = r, min((c // 8 + 1) * 8, self.width - 1)

    def sequence(self, params: str, final: str) -> None:
        if params.startswith("?"):
            modes = params[1:].split(";")
            if final in "hl" and {"1049", "1047", "47"} & set(modes):
                self.frozen = final == "h"
            if final == "l" and "2004" in modes and self.last_two == "^C" and not self.fed_after:
                self.killed = True
            return
        if self.frozen:
            return
        first = params.split(";")[0]
        given = min(int(first), 1 << 20) if first.isdigit() else 0
        n, (r, c) = given or 1, self.at
        if final == "A":
            self.move(r - n, c)
        elif final in "Be":
            self.move(min(r + n, MOST_ROWS), c)
        elif final in "Ca":
            self.move(r, c + n)
        elif final == "D":
            self.move(r, c - n)
        elif final in "G`":
            self.move(r, n - 1)
        elif final == "K":
            self.clear(r, 0 if given else c, c + 1 if given == 1 else self.width)
        elif final == "J":
            self.erase(given)
        elif final == "P":
            for k in range(c, min(c + n, self.width)):
                self.row(r).pop(k, None)
            self.shift(-n)
        elif final == "@":
            self.shift(n)
        elif final == "X":
            self.clear(r, c, c + n)
        elif final == "L":
            for _ in range(min(n, MOST_ROWS - len(self.rows))):
                self.rows.insert(r, {})
            self.joined = {k + n if k >= r else k for k in self.joined}
        elif final == "M":
            del self.rows[r : r + n]
            self.joined = {k if k < r else k - n for k in self.joined if not r <= k < r + n}
        elif final == "s":
            self.saved = self.at
        elif final == "u":
            self.at = self.saved
        elif final in "HfdrST":
            self.lost = True

    def erase(self, kind: int) -> None:
        r, c = self.at
        if kind == 0:
            self.clear(r, c, self.width)
            del self.rows[r + 1 :]
        elif kind == 1:
            for k in range(min(r, len(self.rows))):
                self.rows[k].clear()
            self.clear(r, 0, c + 1)
        else:
            self.rows.clear()
            self.joined.clear()

    def single(self, ch: str) -> None:
        r, c = self.at
        if ch == "7":
            self.saved = self.at
        elif ch == "8":
            self.at = self.saved
        elif not self.frozen and ch in "MDE":
            self.move(r - 1 if ch == "M" else r + 1, 0 if ch == "E" else c)

    def typed(self, row: dict[int, tuple[str, str]]) -> list[int]:
        """Columns of a row the user wrote, without a decoration set off at the right edge."""
        own = sorted(c for c, (_, phase) in row.items() if phase == INPUT)
        if own and own[-1] >= self.width - 2:
            start = own[-1]
            while start - 1 in row:
                start -= 1
            before = [c for c in row if c < start]
            if before and start - max(before) - 1 >= 3:
                own = [c for c in own if c < start]
        return own

    def text(self) -> str:
        """The logical lines the user wrote, from their first to their last cell."""
        lines: list[str] = []
        cells: dict[int, str] = {}
        base = 0
        for r, row in enumerate(self.rows):
            own = self.typed(row)
            cells |= {base + c: row[c][0] for c in own}
            if r + 1 in self.joined and r + 1 < len(self.rows):
                base += self.width
                continue
            lines.append("".join(cells.get(c, " ") for c in range(min(cells), max(cells) + 1)) if cells else "")
            cells, base = {}, 0
        while lines and not lines[-1].strip():
            lines.pop()
        while lines and not lines[0].strip():
            lines.pop(0)
        return "\n".join(lines).rstrip(" \t\r\n")


def reconstruct(data: bytes, width: int = WIDTH) -> str:
    """The final input line or lines of one echo, or '' if there is none to tell."""
    grid = Grid(width if width > 0 else WIDTH)
    for m in _TOKEN.finditer(data.decode("utf-8", "ignore")):
        if m["text"] is not None:
            if not grid.frozen:
                grid.write(m["text"])
        elif m["final"] is not None:
            grid.sequence(m["params"], m["final"])
        elif m["control"] is not None:
            if not grid.frozen:
                grid.control(m["control"])
        elif m["single"] is not None:
            grid.single(m["single"])
        elif m["string"] in ("hl:P", "hl:B"):
            grid.phase = PROMPT if m["string"] == "hl:P" else INPUT
        if grid.lost:
            return ""
    if grid.killed or (grid.last_two == "^C" and not grid.fed_after):
        return ""
    return grid.text()
