"""Language identification of mixed text.

A word is a letter and the letters and marks that follow it (Unicode categories
L and M). Its script (by the code range of its first letter) narrows the
candidates to the languages seen in that script. Words are scored by the
log-likelihoods of their byte n-grams; Viterbi over a document's words, with a
penalty for each switch, labels spans. The document's language is that of most
letters and marks, its score their share; the spans are returned as well, in
words from 0.

The model is trained on a bounded sample of the labelled rows of the training
fold: about SAMPLE rows, chosen by hash, all rows if there are fewer. It has a
fixed size by language: 2**BITS n-gram buckets.

Cases: a null text or one without a letter (digits, fractions, Roman numeral
signs and lone marks are none) is ``und`` with score 0 and no spans; without any
training row every text is; ties go to the first language by name; repeated
rows are rows of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, held_out, map_rows

SAMPLE = 12_000
BITS = 16
SIZES = (2, 3, 4)
SWITCH = 6.0
SMOOTH = 0.5
#: Words scored in one go.
AT_ONCE = 50_000

# First and last code points of the ranges of each script; any other letter's script is OTHER.
SCRIPTS = {
    "Latin": (
        (0x0041, 0x02FF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A),
    ),
    "Greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x0530, 0x058F), (0xFB13, 0xFB17)),
    "Hebrew": ((0x0590, 0x05FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)),
    "Syriac": ((0x0700, 0x074F),),
    "Thaana": ((0x0780, 0x07BF),),
    "Devanagari": ((0x0900, 0x097F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x0980, 0x09FF),),
    "Gurmukhi": ((0x0A00, 0x0A7F),),
    "Gujarati": ((0x0A80, 0x0AFF),),
    "Oriya": ((0x0B00, 0x0B7F),),
    "Tamil": ((0x0B80, 0x0BFF),),
    "Telugu": ((0x0C00, 0x0C7F),),
    "Kannada": ((0x0C80, 0x0CFF),),
    "Malayalam": ((0x0D00, 0x0D7F),),
    "Sinhala": ((0x0D80, 0x0DFF),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Lao": ((0x0E80, 0x0EFF),),
    "Tibetan": ((0x0F00, 0x0FFF),),
    "Myanmar": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC)),
    "Ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)),
    "Cherokee": ((0x13A0, 0x13FF), (0xAB70, 0xABBF)),
    "Canadian": ((0x1400, 0x167F), (0x18B0, 0x18FF)),
    "Khmer": ((0x1780, 0x17FF), (0x19E0, 0x19FF)),
    "Mongolian": ((0x1800, 0x18AF),),
    "Kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F)),
    "Bopomofo": ((0x3100, 0x312F), (0x31A0, 0x31BF)),
    "Han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "Yi": ((0xA000, 0xA4CF),),
}
OTHER = "Other"
_NAMES = sorted([*SCRIPTS, OTHER])
_RANGES = sorted((a, b, _NAMES.index(name)) for name, own in SCRIPTS.items() for a, b in own)
_STARTS, _ENDS, _SCRIPT_OF = (np.array(column) for column in zip(*_RANGES, strict=True))
_LATIN, _OTHER = _NAMES.index("Latin"), _NAMES.index(OTHER)

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same for texts of Latin letters below the first mark and common punctuation, which are most texts here.
_LETTERS = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
_LATIN_WORD = re.compile(f"[{_LETTERS}]+")
_BEYOND = re.compile("[^\x00-\u02ff\u2010-\u205e\u20ac]")


def split(text: str) -> list[str]:
    """The words of a text, in lower case."""
    text = text.lower()
    return _WORD.findall(text) if _BEYOND.search(text) else _LATIN_WORD.findall(text)


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per n-gram size the bucket at each byte (or -1 across words); each word's first byte and length.

    Words stand in one buffer with a space before, between and after, which the
    n-grams at a word's edges include.
    """
    buffer = np.frombuffer((" " + " ".join(words) + " ").encode(), dtype=np.uint8)
    gaps = np.flatnonzero(buffer == 32)
    starts, lengths = gaps[:-1], np.diff(gaps)  # a word's share begins with the space before it
    wide = np.concatenate((buffer, np.zeros(4, np.uint8))).astype(np.uint64)
    since = np.arange(len(buffer)) - np.repeat(gaps, np.diff(np.concatenate((gaps, [len(buffer)]))))
    left = np.repeat(np.concatenate((lengths, [0])), np.diff(np.concatenate((gaps, [len(buffer)])))) - since
    found = []
    for n in SIZES:
        code = np.zeros(len(buffer), dtype=np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | wide[k : k + len(buffer)]
        code = ((code + np.uint64(n) << np.uint64(3) | np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        inside = n <= left + 1 if n > 1 else since > 0
        found.append(np.where(inside, code.astype(np.int64), -1))
    return found, starts, lengths


@dataclass
class Model:
    """Languages and what is known of them: n-gram log-likelihoods, and the scripts each is written in.

    The table's last row, for n-grams across words, is zero. Likelihoods are
    divided by the number of n-gram sizes, which overlap.
    """

    languages: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) log-likelihoods; languages not seen in a word's script are ruled out."""
        found, starts, _ = grams(words)
        each = self.table[found[0][:-1]]
        for codes in found[1:]:
            each += self.table[codes[:-1]]
        out = np.add.reduceat(each, starts, axis=0)
        script = scripts_of(words)
        if not self.scripts[np.bincount(script, minlength=len(_NAMES)) > 0].all():
            allowed = self.scripts[script] | ~self.scripts[script].any(axis=1, keepdims=True)
            out = np.where(allowed, out, np.float32(-1e6))
        return out


def script_of(words: list[str]) -> np.ndarray:
    """The number of each word's script, by its first letter."""
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    at = np.maximum(np.searchsorted(_STARTS, first, side="right") - 1, 0)
    return np.where((_STARTS[at] <= first) & (first <= _ENDS[at]), _SCRIPT_OF[at], _OTHER)


def scripts_of(words: list[str]) -> np.ndarray:
    """``script_of``, without a look at each word where all are Latin."""
    try:
        "".join(words).encode("latin-1")
    except UnicodeEncodeError:
        return script_of(words)
    return np.full(len(words), _LATIN)


def viterbi(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word, a switch between neighbours costing ``penalty``.

    If no run of words gains more than one penalty over the language that is
    best overall, its label holds throughout; else the recursion is run.
    """
    total = scores.sum(axis=0)
    best = int(total.argmax())
    over = np.cumsum(scores.max(axis=1) - scores[:, best])
    low = np.minimum.accumulate(np.concatenate(([0.0], over[:-1])))
    if (over - low).max() <= penalty:
        return np.full(len(scores), best)
    n, m = scores.shape
    back = np.empty((n, m), dtype=np.int32)
    own, value, rows = list(range(m)), scores[0].tolist(), scores.tolist()
    first = scores.argmax(axis=1)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(first)) + 1, [n]))
    until = np.repeat(starts[1:], np.diff(starts)).tolist()  # where a run of words of one best language ends
    first = first.tolist()
    t = 1
    while t < n:
        top = max(own, key=value.__getitem__)
        least = value[top] - penalty
        if first[t] == top and all(v < least or j == top for j, v in enumerate(value)):
            # Every other language is a switch behind, and stays so to the end of the run.
            end = until[t]
            back[t:end] = top
            row = rows[end - 1]
            value = [row[j] - row[top] - penalty if j != top else 0.0 for j in own]
            t = end
            continue
        row = rows[t]
        back[t] = [j if value[j] >= least else top for j in own]
        value = [row[j] + (value[j] if value[j] >= least else least) for j in own]
        t += 1
    path = np.empty(n, dtype=np.int64)
    path[-1] = max(own, key=value.__getitem__)
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the languages in ``docs`` (text, lang), from about ``sample`` rows chosen by hash."""
    rows = docs.filter("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id", "lang").alias("h"))
    n = docs.filter("text is not null and lang is not null").count()
    if n > sample:
        rows = rows.filter(F.pmod(F.col("h"), F.lit(1_000_000)) < max(1, 1_000_000 * sample // n))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(split(text))
            langs, codes, counts = [], [], []
            for lang, words in by.items():
                if words:
                    found, _, _ = grams(words)
                    number = np.bincount(np.concatenate([c[c >= 0] for c in found]), minlength=1 << BITS)
                    script = np.bincount(script_of(words), minlength=len(_NAMES))
                    number = np.concatenate((number, script))
                    held = np.flatnonzero(number)
                    langs += [lang] * len(held)
                    codes.append(held)
                    counts.append(number[held])
            none = np.zeros(0, dtype=np.int64)
            return batch_of(
                lang=pa.array(langs, pa.string()), code=pa.array(np.concatenate([none, *codes]), pa.int32()), n=pa.array(np.concatenate([none, *counts]), pa.int64())
            )

        return step

    counted = map_rows(rows.select("text", "lang"), make, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    # At most 2**BITS numbers by language, and no more languages than sampled rows.
    names = counted.column("lang").combine_chunks().dictionary_encode() if counted.num_rows else pa.array([], pa.string()).dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    counts = np.zeros(((1 << BITS) + len(_NAMES), len(languages)))
    place = np.array([languages.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)
    counts[counted.column("code").to_numpy(), place[names.indices.to_numpy()]] = counted.column("n").to_numpy()
    seen, script = counts[: 1 << BITS], counts[1 << BITS :]
    table = np.log((seen + SMOOTH) / (seen.sum(axis=0) + SMOOTH * (1 << BITS))) if languages else seen
    table -= table.mean(axis=1, keepdims=True) if languages else 0
    table = np.vstack((table / len(SIZES), np.zeros((1, table.shape[1]))))
    return Model(languages, table.astype(np.float32), script > 0.001 * script.sum(axis=0))


SPANS = "doc_id long, lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"
_SPAN = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, language, score, and the spans of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, shares = [], []
            starts, sizes, labels, ends = [], [], [], [0]
            for words, scores in scored(split(t) if t else [] for t in batch.column(1).to_pylist()):
                if not words or not model.languages:
                    langs.append("und")
                    shares.append(0.0)
                    ends.append(ends[-1])
                    continue
                path = viterbi(scores)
                letters = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                weight = np.bincount(path, weights=letters, minlength=len(model.languages))
                best = int(weight.argmax())
                langs.append(model.languages[best])
                shares.append(float(weight[best] / weight.sum()))
                new = np.flatnonzero(np.concatenate(([True], np.diff(path) != 0)))
                starts.append(new)
                sizes.append(np.diff(np.concatenate((new, [len(path)]))))
                labels.append(path[new])
                ends.append(ends[-1] + len(new))
            none = np.zeros(0, dtype=np.int64)
            start, size, own = (pa.array(np.concatenate([none, *x]), pa.int32()) for x in (starts, sizes, labels))
            lang = pa.array(model.languages, pa.string()).take(own)
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([start, size, lang], fields=list(_SPAN)))
            return batch_of(doc_id=batch.column(0), lang_pred=pa.array(langs), score=pa.array(shares, pa.float64()), spans=spans)

        def scored(texts: Iterator[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
            """Each text's words with their scores, computed for about AT_ONCE words at a time."""
            held: list[list[str]] = []
            size = 0

            def flush() -> Iterator[tuple[list[str], np.ndarray]]:
                words = [w for own in held for w in own]
                parts = [model.scores(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)] if model.languages else []
                scores = np.concatenate(parts) if parts else np.zeros((len(words), 0))
                at = 0
                for own in held:
                    yield own, scores[at : at + len(own)]
                    at += len(own)

            for words in texts:
                held.append(words)
                size += len(words)
                if size >= AT_ONCE:
                    yield from flush()
                    held, size = [], 0
            yield from flush()

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, SPANS)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans. Trained on the rows not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return label(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
