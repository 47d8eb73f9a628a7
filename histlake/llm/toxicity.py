"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words and writes classes: insults (learned, with a
weight each), threats, targets, negations and reports (closed lists of four
languages). Three small automata read the classes of a clause: words left under
a negation, whether the clause reports someone's speech, and words since a
target. They are composed into one automaton (``compose``), which runs from left
to right; the target automaton also runs from right to left, for targets still
to come. Where an insult or a threat is read, the two states name the channel
that its weight goes to (plain, targeted, negated, reported, threat, or none). A
document's score is a logistic function of what its clauses wrote, so no
isolated word decides by itself. Both runs are linear in the clause.

Insults are whole words and word beginnings, weighted by the lower confidence
bound of how often they occur in toxic texts only. Lexicon and logistic weights
are learned from at most SAMPLE labelled ids of the training fold, those of the
least hashes, which bounds the lexicon as well.

Cases: null and empty texts match nothing and get the base score; without any
toxic training row every score is 0; labels of repeated ids count once, toxic if any is;
repeated rows and null ids are rows of their own; an empty table gives no rows;
other columns are ignored by the operator and kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, staged, text_bytes

SAMPLE = 16_000
SUPPORT = 3
LEAST_WEIGHT = 1.5
PREFIX = range(3, 10)
THRESHOLD = 0.7
WORDS_KEPT = 300_000
Z = 2.6

# Closed word classes (English, French, German, Spanish).
NEGATION = frozenset("not no never isn't aren't don't doesn't wasn't pas jamais ni nicht kein keine nie nunca tampoco".split())
REPORT = frozenset("said says wrote claimed called alleged quoted reported dit écrit affirme prétend sagte schrieb behauptet dijo escribió afirma".split())
TARGET = frozenset("you your he she they them him her we us people everyone this that tu vous toi il elle ils du ihr er sie euch usted ustedes ellos".split())
THREAT = frozenset("kill hurt destroy beat shoot stab punch hang burn tuer frapper détruire töten schlagen zerstören matar golpear destruir".split())

#: Words a negation reaches, and words within which a target counts.
NEGATION_REACH, TARGET_REACH = 3, 4
CHANNELS = ("plain", "targeted", "negated", "reported", "threat")
FEATURES = ("bias", *CHANNELS, "strongest", "dense")

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


def terms(word: str) -> list[str]:
    """What a word may be known by: itself, and its beginnings."""
    return [word + "$", *(word[:k] + "*" for k in PREFIX if k <= len(word))]


#: The symbols that clause automata read.
OTHER, INSULT, THREATENS, AIMS, NEGATES, REPORTS = SYMBOLS = range(6)


@dataclass
class Automaton:
    """A deterministic automaton over SYMBOLS: its states by number, the first one, and the next one by state and symbol."""

    states: list
    first: int
    next: list[list[int]]


def automaton(first, step: Callable) -> Automaton:
    """The states that can be reached from ``first`` by ``step(state, symbol)``."""
    number, states, table = {first: 0}, [first], []
    for state in states:
        row = []
        for symbol in SYMBOLS:
            after = step(state, symbol)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        table.append(row)
    return Automaton(states, 0, table)


def compose(*parts: Automaton) -> Automaton:
    """One automaton that runs all parts at once; its states are theirs, side by side."""
    joint = automaton(tuple(p.first for p in parts), lambda state, symbol: tuple(p.next[s][symbol] for p, s in zip(parts, state, strict=True)))
    joint.states = [tuple(p.states[s] for p, s in zip(parts, state, strict=True)) for state in joint.states]
    return joint


#: Words that a negation still reaches; whether speech is reported; words since a target, up to beyond its reach.
NEGATED = automaton(0, lambda left, symbol: NEGATION_REACH if symbol == NEGATES else max(0, left - 1))
REPORTED = automaton(False, lambda said, symbol: said or symbol == REPORTS)
SINCE = automaton(TARGET_REACH + 1, lambda since, symbol: 1 if symbol == AIMS else min(since + 1, TARGET_REACH + 1))
CLAUSE = compose(NEGATED, REPORTED, SINCE)


def channel(state: tuple, ahead: int, symbol: int) -> str | None:
    """The channel that an insult or a threat is written to, by the state of CLAUSE before it and that of SINCE from the right."""
    negated, reported, since = state
    aimed = min(since, ahead) <= TARGET_REACH
    if symbol == THREATENS:
        return "threat" if aimed and not negated and not reported else None
    return "negated" if negated else "reported" if reported else "targeted" if aimed else "plain"


#: ``channel`` for all states, by symbol.
WRITES = {x: [[channel(s, t, x) for t in SINCE.states] for s in CLAUSE.states] for x in (INSULT, THREATENS)}


@dataclass
class Grammar:
    """The learned part: weights of insult terms, and of the channels."""

    insults: dict[str, float]
    weights: list[float]


class Machine:
    """The grammar at work in one task."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.known: dict[str, tuple[int, float]] = {}

    def read(self, word: str) -> tuple[int, float]:
        """The lexicon transducer: a word's class and weight."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        found = OTHER, 0.0
        weight = max((self.grammar.insults.get(t, 0.0) for t in terms(word)), default=0.0)
        if weight > 0:
            found = INSULT, weight
        for symbol, words in ((NEGATES, NEGATION), (REPORTS, REPORT), (THREATENS, THREAT), (AIMS, TARGET)):
            if word in words:
                found = symbol, 1.0
        self.known[word] = found
        return found

    def clause(self, read: list[tuple[int, float]], out: dict[str, float]) -> float:
        """The clause automata over classes and weights; adds to the channels, returns the strongest score written."""
        ahead, state = [], SINCE.first
        for symbol, _ in reversed(read):
            ahead.append(state)
            state = SINCE.next[state][symbol]
        strongest, state = 0.0, CLAUSE.first
        for (symbol, weight), to_come in zip(read, reversed(ahead), strict=True):
            if symbol in WRITES and (name := WRITES[symbol][state][to_come]):
                out[name] += weight
                if symbol == INSULT:
                    strongest = max(strongest, weight if name in ("plain", "targeted") else weight / 2)
            state = CLAUSE.next[state][symbol]
        return strongest

    def features(self, text: str) -> list[float]:
        """What the clauses of a text write, in the order of FEATURES."""
        text = text.lower()
        out = dict.fromkeys(CHANNELS, 0.0)
        strongest = 0.0
        words = _WORD.findall(text)
        read, loud = self.read, WRITES.keys()
        if any(read(w)[0] in loud for w in words):
            for part in _CLAUSE.split(text):
                own = [read(w) for w in _WORD.findall(part)]
                if any(c in loud for c, _ in own):
                    strongest = max(strongest, self.clause(own, out))
        total = out["plain"] + out["targeted"]
        return [1.0, *(math.log1p(v) for v in out.values()), strongest, total / math.log(len(words) + 8)]

    def score(self, features: list[float]) -> float:
        x = sum(a * b for a, b in zip(features, self.grammar.weights, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled ids, those of the least hashes; near copies once."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most ``sample`` pairs of numbers, whatever the corpus: small enough to broadcast.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    signed = staged(map_rows(rows, _signer, "text string, toxic int, m1 long, m2 long"), "labelled")
    for own, other in (("m1", "m2"), ("m2", "m1")):
        one = F.min_by(F.struct("text", other), F.xxhash64("text")).alias("one")  # the same one in every run
        signed = signed.groupBy(own, "toxic").agg(one).select(own, "toxic", "one.text", f"one.{other}")
    return signed


def _signer():
    """Adds two min-hashes over five-word shingles: near copies agree on one or the other, mostly."""

    def least(words: list[bytes], seed: int) -> int:
        own = range(max(1, len(words) - 4))
        return min(xxhash.xxh64_intdigest(b" ".join(words[k : k + 5]), seed) for k in own) >> 1

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.lower().split() for t in text_bytes(batch.column(0))]
        marks = [pa.array([least(w, seed) for w in words], pa.int64()) for seed in (1, 2)]
        return pa.RecordBatch.from_arrays([*batch.columns, *marks], names=["text", "toxic", "m1", "m2"])

    return step


def _lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Weights of the terms that speak for toxic texts, by all rows (text, toxic, half), by those of half 0, and of half 1."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict[str, list[int]] = {}
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}
                for t in own:
                    seen.setdefault(t, [0, 0, 0, 0])[2 * half + toxic] += 1
            counts = [pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], names=["term", "clean0", "toxic0", "clean1", "toxic1"])

        return step

    totals = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    each = map_rows(rows.select("text", "toxic", "half"), make, "term string, clean0 long, toxic0 long, clean1 long, toxic1 long")
    counted = each.groupBy("term").agg(*[F.sum(f"{k}{h}").alias(f"{k}{h}") for k in ("clean", "toxic") for h in (0, 1)]).filter(F.expr("toxic0 + toxic1") >= SUPPORT)
    weights = []
    for halves in ((0, 1), (0,), (1,)):
        toxic, clean = (sum(totals.get((h, k), 0) for h in halves) for k in (1, 0))
        if not toxic or not clean:
            weights.append(F.lit(0.0))
            continue
        a, n = sum(F.col(f"toxic{h}") for h in halves), sum(F.col(f"toxic{h}") + F.col(f"clean{h}") for h in halves)
        p = a / n
        low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
        weights.append(F.when(a >= SUPPORT, F.log(low / (1 - low)) - F.lit(math.log(toxic / clean))).otherwise(F.lit(0.0)))
    found = counted.select("term", F.array(*weights).alias("w")).filter(F.exists("w", lambda w: w >= LEAST_WEIGHT)).collect()
    return [{r["term"]: r["w"][k] for r in found if r["w"][k] >= LEAST_WEIGHT} for k in range(3)]


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by damped Newton steps, drawn towards a prior in which negation and report count little."""
    prior = np.array([-3.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.5, 0.5])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while loss(w + size * step) > now and size > 1e-6:
            size /= 2
        w = w + size * step
        last, now = now, loss(w)
        if last - now < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammar of the labelled rows among ``docs``."""
    half = F.pmod(F.xxhash64("m1"), F.lit(2)).cast("int")
    rows = staged(_sampled(docs, labels, sample).select("text", "toxic", half.alias("half")), "sampled")
    insults, *halves = _lexicons(rows)
    if not insults:
        return Grammar({}, [-30.0] + [0.0] * (len(FEATURES) - 1))
    # Channel weights are fitted on either half under the other half's lexicon,
    # as a lexicon looks better than it is on the rows it was made of.
    found = _featured(rows, [Grammar(h, []) for h in reversed(halves)]).collect()
    found.sort(key=lambda r: (r["toxic"], r["features"]))  # sums are then the same in every run
    x = np.array([r["features"] for r in found]).reshape(-1, len(FEATURES))
    y = np.array([r["toxic"] for r in found], dtype=float)
    return Grammar(insults, _fit(x, y).tolist())


def _featured(rows: DataFrame, grammars: list[Grammar]) -> DataFrame:
    """Whether each row is toxic, and its features under the grammar for its half."""
    shared = rows.sparkSession.sparkContext.broadcast(grammars)

    def make():
        machines = [Machine(g) for g in shared.value]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [machines[h].features(t or "") for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.float64()))], names=["toxic", "features"])

        return step

    return map_rows(rows.select("text", "toxic", "half"), make, "toxic int, features array<double>")


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def make():
        machine = Machine(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [machine.score(machine.features(t or "")) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], names=["doc_id", "score"])

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Trained on the rows not held out."""
    grammar = train(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))))
    rows = score(docs, grammar)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored below THRESHOLD, all columns kept."""
    grammar = train(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index("text")

    def make():
        machine = Machine(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([machine.score(machine.features(t or "")) < THRESHOLD for t in batch.column(at).to_pylist()]))

        return step

    return map_rows(docs, make, docs.schema)
