"""Terminal byte streams cut into commands: one incremental machine for batch and stream.

Bytes are split into plain runs and whole escape sequences; a sequence cut off
at the end of a chunk waits for the next one, so any chunking gives the same
commands. The machine's state is a small picklable object, bounded by the
capture and echo caps, and serves a streaming job as it is.
"""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass, field

from ..functions.commandline import unquote
from ..functions.terminal import strip
from ..functions.text import osc7_path, percent_decode, vsc_unescape, windows_path
from .capture import HEAD_CAP, TAIL_CAP, HeadTail
from .echo import ECHO_CAP, INPUT, INPUT_MARK, PROMPT, PROMPT_MARK, WIDTH, reconstruct

SEQUENCE_CAP = 1 << 16
UNKNOWN = "(unknown command)"

_TOKEN = re.compile(
    rb"(?P<plain>(?:[^\x1b]++|\x1b\[[0-9;:]{0,1000}+[\x40-\x7e])++)|\x1b\](?P<osc>(?:[^\x07\x1b]|\x1b(?!\\))*)(?:\x07|\x1b\\)|\x1b\[(?P<csi>[^\x40-\x7e]*[\x40-\x7e])|(?P<other>\x1b[^\[\]])", re.S
)
# A run of plain bytes holds colours and cursor moves as well: they change no state.
_EXIT = re.compile(r"\s*(?:exit(?:\s+[0-9]+)?|logout)\s*")
_USER_VAR = re.compile(r"1337;SetUserVar=([A-Za-z0-9+/]+)=([A-Za-z0-9+/]*=*)")
_PROG = "1337;SetUserVar=WEZTERM_PROG="
_WRAPPED = 76  # characters of a base64 line that may have a continuation


@dataclass
class Command:
    """One finished command of a session."""

    cmd: str
    cwd: str
    exit_code: int | None
    started_ms: int
    ended_ms: int
    output: bytes
    plain: str
    truncated: bool


@dataclass
class Segmenter:
    """Feed it a session's chunks in order; it returns the commands they finish."""

    head_cap: int = HEAD_CAP
    tail_cap: int = TAIL_CAP
    width: int = WIDTH
    ignore: tuple[str, ...] = ()
    pending: bytes = b""
    capturing: bool = False
    alternate: bool = False
    paused: bool = False
    buffer: HeadTail | None = None
    cwd: str = ""
    told: str = ""
    hint: str = ""
    echoed: str = ""
    split_value: str = ""
    phase: str = ""
    echo: bytes = b""
    echo_has_input: bool = False
    echo_over: bool = False
    started_ms: int = 0
    done: list[Command] = field(default_factory=list)

    def feed(self, chunk: bytes, now_ms: int = 0) -> list[Command]:
        data, at = self.pending + chunk, 0
        while at < len(data):
            m = _TOKEN.match(data, at)
            if m is None:
                break
            at = m.end()
            if m["plain"] is not None:
                self._bytes(m["plain"])
            elif m["osc"] is not None:
                self._osc(m["osc"][:SEQUENCE_CAP], now_ms)
            elif m["csi"] is not None:
                if len(m["csi"]) <= SEQUENCE_CAP:
                    self._modes(m["csi"])
                    self._bytes(m.group())
            else:
                self._bytes(m["other"])
        self.pending = self._waiting(data[at:])
        out, self.done = self.done, []
        return out

    def _waiting(self, rest: bytes) -> bytes:
        """An unfinished sequence, kept within its cap: a longer string loses its middle, a longer control is dropped."""
        if len(rest) <= SEQUENCE_CAP + 2:
            return rest
        if rest[1:2] == b"[":
            return b""
        return rest[: SEQUENCE_CAP + 2] + (b"\x1b" if rest.endswith(b"\x1b") else b"")

    def finish(self, now_ms: int = 0) -> list[Command]:
        """The end of the stream: what is open is kept, with an unknown exit."""
        if _EXIT.fullmatch(self._name()):
            self.buffer = None
        self._flush(None, now_ms)
        out, self.done = self.done, []
        return out

    def _bytes(self, data: bytes) -> None:
        if self.capturing and not self.alternate:
            if self.buffer is not None:
                self.buffer.write(data)
        elif self.phase:
            self._echo(data)

    def _modes(self, csi: bytes) -> None:
        if csi[:1] == b"?" and csi[-1:] in (b"h", b"l") and {b"1049", b"1047", b"47"} & set(csi[1:-1].split(b";")):
            self.alternate = csi[-1:] == b"h"

    def _echo(self, data: bytes) -> None:
        """Adds to the echo; one over its cap is given up whole, as a part would mislead."""
        if self.echo_over:
            return
        if len(self.echo) + len(data) > ECHO_CAP:
            self.echo, self.echo_over = b"", True
        else:
            self.echo += data

    def _no_echo(self) -> None:
        self.phase, self.echo, self.echo_has_input, self.echo_over = "", b"", False, False

    def _prompt(self, params: str = "") -> None:
        """A prompt begins; a secondary one continues the region."""
        if not ("k=s" in params.split(";") and self.echo_has_input):
            self._no_echo()
        self.phase = PROMPT
        self._echo(PROMPT_MARK)

    def _input(self) -> None:
        if self.phase != PROMPT:
            self._no_echo()
        self.phase, self.echo_has_input = INPUT, True
        self._echo(INPUT_MARK)

    def _start(self, now_ms: int) -> None:
        self.capturing, self.alternate = True, False
        if self.echo_has_input and not self.echo_over:
            self.echoed = reconstruct(self.echo, self.width)
        self._no_echo()
        self.buffer, self.started_ms = HeadTail(self.head_cap, self.tail_cap), now_ms

    def _end(self, params: str, now_ms: int) -> None:
        self._no_echo()
        if self.capturing:
            self.capturing = False
            code = params.split(";")[0]
            self._flush(int(code) if re.fullmatch(r"[+-]?[0-9]{1,18}", code) else None, now_ms)

    def _mark(self, rest: str, now_ms: int) -> bool:
        """The marks both protocols share; whether it was one."""
        kind, _, params = rest.partition(";")
        if kind == "C":
            self._start(now_ms)
        elif kind == "D":
            self._end(params, now_ms)
        elif kind == "B":
            self._input()
        elif kind == "A":
            self._prompt()
        else:
            return False
        return True

    def _osc(self, raw: bytes, now_ms: int) -> None:
        payload = raw.decode("utf-8", "surrogateescape")
        if self.split_value:
            if m := _USER_VAR.fullmatch(payload):
                self.split_value += m[1] + m[2]
                return
            self._program(self.split_value)
            self.split_value = ""
        if payload.startswith("133;"):
            rest = payload[4:]
            kind, _, params = rest.partition(";")
            if kind in ("A", "P") and (kind == "A" or rest[1:2] == ";"):
                self._prompt(params)
            else:
                self._mark(rest, now_ms)
            if kind == "C" and params:
                self._command_parameter(params)
        elif payload.startswith("633;"):
            rest = payload[4:]
            if rest.startswith("E;"):
                self.hint = vsc_unescape(rest[2:].rpartition(";")[0] if ";" in rest[2:] else rest[2:])
            elif rest.startswith("P;Cwd="):
                self.cwd = vsc_unescape(rest[6:])
            else:
                self._mark(rest, now_ms)
        elif payload.startswith("1337;CurrentDir="):
            self.cwd = payload.partition("=")[2]
        elif payload.startswith(("1337;RemoteHost=", "1337;ShellIntegrationVersion=")):
            pass
        elif payload.startswith(_PROG):
            value = "".join(payload[len(_PROG) :].split())
            if len(value) == _WRAPPED:
                self.split_value = value
            else:
                self._program(value)
        elif payload.startswith("6973;cmd="):
            if (text := _decoded(payload[9:])) is not None:
                self.told = text
        elif payload in ("6973;rec=on", "6973;rec=off"):
            self.paused = payload.endswith("off")
        elif payload.startswith("7;"):
            self.cwd = osc7_path(payload[2:])
        elif payload.startswith("9;9;"):
            self.cwd = windows_path(payload[4:].strip('"'))
        elif self.capturing and not self.alternate and self.buffer is not None:
            self.buffer.write(b"\x1b]" + raw + b"\x07")

    def _command_parameter(self, params: str) -> None:
        if params.startswith("cmdline="):
            self.hint = unquote(params[8:]) or self.hint
        else:
            for p in params.split(";"):
                if p.startswith("cmdline_url="):
                    self.hint = percent_decode(p[12:])

    def _program(self, value: str) -> None:
        self.hint = _decoded(value) or self.hint

    def _name(self) -> str:
        return self.told or self.hint or self.echoed

    def _flush(self, exit_code: int | None, now_ms: int) -> None:
        name, buffer = self._name(), self.buffer
        self.told = self.hint = self.echoed = ""
        self.buffer = None
        if buffer is None or self.paused or _EXIT.fullmatch(name) or any(re.search(p, name) for p in self.ignore):
            return
        raw = buffer.value()
        plain = strip(raw)
        if not name and (not plain or (not exit_code and plain.strip() in (b"exit", b"logout"))):
            return
        self.done.append(Command(name or UNKNOWN, self.cwd, exit_code, self.started_ms, now_ms, raw, plain.decode("utf-8", "replace"), buffer.truncated()))


def _decoded(value: str) -> str | None:
    """Strict base64 as text; None if it is none."""
    try:
        return base64.b64decode(value, validate=True).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        return None
