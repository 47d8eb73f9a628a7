"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Kinds, in order: email, ip, card (Luhn), phone; then those this operator adds:
iban (mod-97, length by country), ssn. The first four are the base kinds: their
matches are leftmost, non-overlapping per kind, and one that fails its check is
dropped without a retry. An added span is dropped where it overlaps a base one.
Offsets are code points, ends exclusive.

Score: a prior of the kind, raised by a passed checksum and by words of the
kind nearby (CONTEXT_CHARS before, as many after), lowered by words that say
the number is something else. The score never removes a base span.

Every pattern runs in time linear in the text: runs of one character class are
entered at their start only.

Cases: null and empty texts have no spans; repeated rows and null ids are rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = (*BASE, *ADDED)
RANK = {k: n for n, k in enumerate(KINDS)}
CONTEXT_CHARS = 40

# Prior score by kind, and what a passed checksum adds.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.3, "ssn": 0.2}
CHECKED = {"card": 0.4, "iban": 0.5}
# Context words by kind (English, French, German, Spanish), and words against any number.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "courriel", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "client", "login", "adresse", "servidor"),
    "card": ("card", "visa", "credit", "debit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telephone", "telefon", "anrufen", "llame", "numéro"),
    "iban": ("iban", "bank", "account", "banque", "konto", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = ("version", "order", "invoice", "isbn", "serial", "build", "ticket")
NEAR, NOT_NEAR = 0.15, -0.2
# IBAN lengths by country.
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
#: The least score at which an added span without a checksum counts.
ADDED_SCORE = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(
    r"(?<![A-Za-z0-9])(?:" + "|".join(f"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTH.items()) + r")(?![^\W_])"
)
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    """The digits' Luhn sum is divisible by 10."""
    own = [ord(d) - 48 for d in reversed(digits)]
    return (sum(own[::2]) + sum((2 * d) % 10 + d // 5 for d in own[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The mod-97 check: country and check digits moved last, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The run of local characters before each @ that a domain follows, from the last match on."""
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    m = _IBAN.search(text)
    while m:
        held = mod97(m.group().replace(" ", ""))
        if held:
            yield "iban", m.start(), m.end()
        m = _IBAN.search(text, m.end() if held else m.start() + 1)
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start]) + _WORD.findall(text[end : end + CONTEXT_CHARS])}
    value = PRIOR[kind] + CHECKED.get(kind, 0.0)
    value += NEAR * any(w in near for w in CONTEXT[kind]) + NOT_NEAR * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, value)), 4)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in order."""
    found = [("email", a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        for m in _IP.finditer(text):
            if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m.group().split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().translate(_DIGITS) if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(m.group().translate(_DIGITS)) <= 15:
                found.append(("phone", m.start(), m.end()))
        base = list(found)
        for kind, a, b in _added(text):
            if not any(a < y and x < b for _, x, y in base) and (kind in CHECKED or score(text, kind, a, b) >= ADDED_SCORE):
                found.append((kind, a, b))
    found.sort(key=lambda s: (s[1], RANK[s[0]]))
    return [(k, a, b, score(text, k, a, b)) for k, a, b in found]


FOUND = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and the scored spans of each document."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t or "")] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

        return step

    return map_rows(docs.select("doc_id", "text"), make, FOUND.replace("text string, ", ""))


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def digest(docs: DataFrame) -> DataFrame:
    """The spans of each document as counts and joined strings."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "top_score"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find(text or "")
                base = [s for s in spans if s[0] in BASE]
                count = [sum(s[0] == k for s in base) for k in BASE]
                rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), max((s[3] for s in spans), default=None)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double")


def redact(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The documents with each span of at least this score replaced by its kind in angle brackets.

    Overlapping spans become one replacement, named by the first. All columns
    stay; n_chars, where there is one, follows the new text.
    """
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, last, until = [], 0, 0
        for kind, a, b, value in find(text):
            if value < least_score:
                continue
            if a >= until:
                out += [text[last:a], f"<{kind.upper()}>"]
            last = until = max(b, until)
        return "".join([*out, text[last:]])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            cols = [texts if k == at else c for k, c in enumerate(batch.columns)]
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([o if t is None else len(t) for o, t in zip(cols[k].to_pylist(), texts.to_pylist(), strict=True)], cols[k].type)
            return pa.RecordBatch.from_arrays(cols, names=names)

        return step

    return map_rows(docs, make, docs.schema)
