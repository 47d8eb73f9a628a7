"""Terminal output as plain text or HTML: one tokenizer of escape sequences, two renderers.

A regex splits the bytes into sequences, controls and runs of plain bytes, so
the loops below step over tokens, not bytes.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    rb"\x1b(?:\[(?P<csi>[^\x40-\x7e]*)(?P<final>[\x40-\x7e]|\Z)|\](?:[^\x07\x1b]|\x1b(?!\\))*(?:\x07|\x1b\\|\Z)|[PX^_](?:[^\x1b]|\x1b(?!\\))*(?:\x1b\\|\Z)|[()#][\s\S]?|[\s\S]|\Z)"
    rb"|(?P<crlf>\r(?=\n))|(?P<cr>\r)|(?P<lf>\n)|(?P<tab>\t)|(?P<back>\x08)|(?P<drop>[\x00-\x1f\x7f])|(?P<plain>[^\x00-\x1f\x7f]+)"
)


# Output without overwriting: text, line ends, tabs, and control sequences of plain parameters.
_CSI = rb"\x1b\[[0-9;:?]*+[\x40-\x7e]"
_SIMPLE = re.compile(rb"(?:[^\x00-\x1f\x7f]++|[\n\t]|\r\n|" + _CSI + rb")*+")
_SEQUENCE = re.compile(_CSI)


def strip(data: bytes) -> bytes:
    """Printable text: escapes and controls gone, lines overwritten after a carriage return resolved."""
    if _SIMPLE.fullmatch(data):
        return _SEQUENCE.sub(b"", data).replace(b"\r\n", b"\n").replace(b"\t", b" ")
    return _resolved(data)


def _resolved(data: bytes) -> bytes:
    """``strip``, token by token."""
    lines: list[bytes] = []
    line = bytearray()
    for m in _TOKEN.finditer(data):
        kind = m.lastgroup
        if kind == "plain":
            line += m.group()
        elif kind == "lf":
            lines.append(bytes(line))
            line.clear()
        elif kind == "tab":
            line += b" "
        elif kind == "cr":
            line.clear()
        elif kind == "back":
            del line[-1:]
    return b"\n".join([*lines, bytes(line)])


def strip_text(data: bytes) -> str:
    return strip(data).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _strip_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else strip_text(x.encode() if isinstance(x, str) else bytes(x)))


def strip_ansi(text: Column) -> Column:
    """``strip`` of a text; what has no control but line feeds stays in the JVM."""
    special = F.rlike(text, F.lit(r"[\x00-\x09\x0b-\x1f\x7f]"))
    return F.coalesce(_strip_udf(F.when(special, text)), text)


def plain_of(plain: Column, output: Column) -> Column:
    """The stored text, or the stripped output where there is none."""
    text = F.coalesce(_strip_udf(output), F.lit(""))
    return F.when(F.coalesce(plain, F.lit("")) == "", text).otherwise(plain)


# Style attributes: SGR code to (name, value) pairs.
_SWITCH = {
    1: (("bold", True), ("dim", False)), 2: (("dim", True), ("bold", False)), 3: (("italic", True),), 4: (("underline", True),), 7: (("reverse", True),),
    9: (("strike", True),), 21: (("bold", False), ("dim", False)), 22: (("bold", False), ("dim", False)), 23: (("italic", False),),
    24: (("underline", False),), 27: (("reverse", False),), 29: (("strike", False),), 39: (("fg", ""),), 49: (("bg", ""),),
}
_CLASSES = (("bold", "bo"), ("dim", "di"), ("italic", "it"), ("underline", "ul"), ("strike", "st"))
_CUBE = (0, 95, 135, 175, 215, 255)


def indexed_color(n: int) -> str:
    """A palette number below 16, else the colour of the xterm cube or ramp."""
    if n < 16:
        return str(n)
    if n < 232:
        n -= 16
        return "#{:02x}{:02x}{:02x}".format(_CUBE[n // 36], _CUBE[n // 6 % 6], _CUBE[n % 6])
    return "#" + f"{8 + 10 * (n - 232):02x}" * 3


def apply_sgr(style: dict, params: str) -> dict:
    """The style after an SGR sequence; a malformed extended colour ends its reading."""
    codes = [int(p) if p.isdigit() else 0 if p == "" else -1 for p in params.replace(":", ";").split(";")]
    style, at = dict(style), 0
    while at < len(codes):
        n = codes[at]
        at += 1
        if n == 0:
            style = {}
        elif n in _SWITCH:
            style.update(_SWITCH[n])
        elif n in (38, 48):
            which = "fg" if n == 38 else "bg"
            if codes[at : at + 1] == [5] and len(codes) > at + 1 and 0 <= codes[at + 1] <= 255:
                style[which] = indexed_color(codes[at + 1])
                at += 2
            elif codes[at : at + 1] == [2] and len(codes) > at + 3 and all(0 <= c <= 255 for c in codes[at + 1 : at + 4]):
                style[which] = "#{:02x}{:02x}{:02x}".format(*codes[at + 1 : at + 4])
                at += 4
            else:
                break
        else:
            for low, which, base in ((30, "fg", 0), (40, "bg", 0), (90, "fg", 8), (100, "bg", 8)):
                if low <= n < low + 8:
                    style[which] = str(n - low + base)
    return {k: v for k, v in style.items() if v}


def _span(style: dict, text: str) -> str:
    fg, bg, plain_reverse = style.get("fg", ""), style.get("bg", ""), False
    if style.get("reverse"):
        fg, bg = bg, fg
        plain_reverse = not fg and not bg
    classes, css = [], []
    for value, letter, name in ((fg, "f", "color"), (bg, "b", "background")):
        if value.startswith("#"):
            css.append(f"{name}:{value}")
        elif value:
            classes.append(letter + value)
    classes += [c for k, c in _CLASSES if style.get(k)] + ["rv"] * plain_reverse
    shown = html.escape(text, quote=False)
    if not classes and not css:
        return shown
    parts = [f' class="{" ".join(classes)}"' if classes else "", f' style="{";".join(css)}"' if css else ""]
    return f"<span{''.join(parts)}>{shown}</span>"


def render(data: bytes) -> str:
    """HTML of terminal output, safe inside <pre>: text, spans and line feeds; tabs stay."""
    out: list[str] = []
    line: list[tuple[dict, bytearray]] = []
    style: dict = {}

    def flush() -> None:
        out.extend(_span(s, t.decode("utf-8", "replace")) for s, t in line)
        line.clear()

    for m in _TOKEN.finditer(data):
        kind = m.lastgroup
        if kind in ("plain", "tab"):
            if not line or line[-1][0] != style:
                line.append((style, bytearray()))
            line[-1][1].extend(m.group())
        elif kind == "lf":
            flush()
            out.append("\n")
        elif kind == "cr":
            line.clear()
        elif kind == "back" and line:
            del line[-1][1][-1:]
            if not line[-1][1]:
                line.pop()
        elif kind == "final" and m["final"] == b"m":
            style = apply_sgr(style, m["csi"].decode("latin-1"))
    flush()
    return "".join(out)


@F.pandas_udf(T.StringType())
def ansi_html(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else render(x.encode() if isinstance(x, str) else bytes(x)))
