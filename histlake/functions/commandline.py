"""Command-line text: heads, operators, assignments, quoting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Commands that run another command.
WRAPPERS = frozenset("sudo doas env command builtin exec time nohup stdbuf timeout watch xargs".split())
# Tools whose first subcommand belongs to the name.
TOOLS = frozenset(
    "git docker podman kubectl npm pnpm yarn bun deno cargo go pip pip3 uv poetry brew apt apt-get dnf pacman systemctl terraform gcloud aws az gh glab "
    "just make nix helm bundle rake mvn gradle composer svn hg jj".split()
)
_OPERATOR = re.compile(r"[0-9]*[|&;<>()]")
_ASSIGNMENT = re.compile(r"[A-Za-z0-9_]+=")


def is_shell_operator(word: str) -> bool:
    return _OPERATOR.match(word) is not None


def is_assignment(word: str) -> bool:
    return _ASSIGNMENT.match(word) is not None


def head_of(line: str) -> str:
    """The name a command goes by: wrappers, flags and assignments skipped, a tool's subcommand kept."""
    words = line.partition("\n")[0].split()
    wrapper = ""
    for k, word in enumerate(words):
        name = word.removeprefix("\\")
        if is_shell_operator(name):
            break
        if not name or name[0] == "-" or is_assignment(name):
            continue
        if "/" in name:
            name = name.rstrip("/").rpartition("/")[2] or "/"
        if name in WRAPPERS:
            wrapper = name
            continue
        return f"{name} {sub}" if name in TOOLS and (sub := _subcommand(words[k + 1 :])) else name
    return wrapper or "(other)"


def _subcommand(words: list[str]) -> str:
    for word in words:
        if is_shell_operator(word):
            return ""
        if word[0] not in "-.~" and "/" not in word and not is_assignment(word):
            return word
    return ""


def command_head(cmd: Column) -> Column:
    """``head_of`` as an expression.

    A line that begins with a word free of anything special which is no wrapper
    and no tool goes by that word, in the JVM; the rest go through Python.
    """
    first = F.regexp_extract(cmd, r"^([A-Za-z0-9_][A-Za-z0-9_.+-]*)(?:[ \t][^\n]*)?(?:\n|$)", 1)
    plain = (first != "") & ~first.isin(*sorted(WRAPPERS | TOOLS))
    return F.when(plain, first).otherwise(_head_udf(F.when(~plain, cmd)))


@F.pandas_udf(T.StringType())
def _head_udf(cmd: pd.Series) -> pd.Series:
    known = {c: head_of(c) for c in cmd.dropna().unique()}
    return pd.Series([known.get(c) for c in cmd], dtype=object)


def shell_exit(cmd: Column) -> Column:
    """Whether the command only leaves the shell."""
    return F.rlike(cmd, F.lit(r"^\s*(exit(\s+[0-9]+)?|logout)\s*$"))


_PLAIN = r"^[A-Za-z0-9_@%+=:,./-]+$"


def shell_quote(text: Column) -> Column:
    """Always in single quotes."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def exec_quote(text: Column) -> Column:
    """In single quotes where a shell would read it otherwise; '' for an empty word."""
    return F.when(F.rlike(text, F.lit(_PLAIN)), text).otherwise(shell_quote(text))


def shell_join(words: Column) -> Column:
    return F.array_join(F.transform(words, exec_quote), " ")


_SIMPLE = {"a": 7, "b": 8, "e": 27, "E": 27, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34, "?": 63}
_ANSI_C = re.compile(r"\\(?:x([0-9A-Fa-f]{1,2})|u([0-9A-Fa-f]{1,4})|U([0-9A-Fa-f]{1,8})|([0-7]{1,3})|c(.)|(.))", re.S)


def ansi_c(body: str) -> bytes:
    """The bytes of a $'…' body; unknown escapes stay."""

    def one(m: re.Match) -> bytes:
        hex2, u4, u8, octal, control, other = m.groups()
        if hex2:
            return bytes([int(hex2, 16)])
        if u4 or u8:
            code = int(u4 or u8, 16)
            return chr(code if code < 0x110000 and not 0xD800 <= code < 0xE000 else 0xFFFD).encode()
        if octal:
            return bytes([int(octal, 8) & 0xFF])
        if control is not None:
            return bytes([ord(control[0]) & 0x1F])
        return bytes([_SIMPLE[other]]) if other in _SIMPLE else m.group().encode()

    out, last = [], 0
    for m in _ANSI_C.finditer(body):
        out += [body[last : m.start()].encode(), one(m)]
        last = m.end()
    return b"".join([*out, body[last:].encode()])


_QUOTED = re.compile(r"""\$'((?:[^'\\]|\\.)*)'|'([^']*)'|"((?:[^"\\]|\\.)*)"|\\(.)|([^\\'"$]+|.)""", re.S)


def unquote(text: str) -> str:
    """A shell-quoted word as the shell would read it; a text that does not parse is returned as it is."""
    out: list[bytes] = []
    at = 0
    while at < len(text):
        m = _QUOTED.match(text, at)
        c, single, double, escaped, plain = m.groups()
        if c is not None:
            out.append(ansi_c(c))
        elif single is not None:
            out.append(single.encode())
        elif double is not None:
            out.append(re.sub(r'\\([$`"\\\n])', lambda e: "" if e[1] == "\n" else e[1], double).encode())
        elif escaped is not None:
            out.append(b"" if escaped == "\n" else escaped.encode())
        elif plain in ("'", '"'):
            return text
        else:
            out.append(plain.encode())
        at = m.end()
    return b"".join(out).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def shell_unquote(text: pd.Series) -> pd.Series:
    """``unquote`` of a column."""
    return pd.Series([None if t is None else unquote(t) for t in text], dtype=object)
