"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the whole corpus, in indexed blocks, and every document is
factored against every block that can hold a factor of ``window`` words.

Which blocks those are follows from anchors: within each window of ``window``
words the SEED-word sequence of the least hash is its anchor, and a phrase is
the words of all consecutive windows with one anchor. Equal windows have equal
anchors, so a factor of a phrase lies in the blocks that hold its anchor, and
no other block need be asked. A phrase that occurs again as a whole is a factor
at once, found by its key; an anchor without a second phrase holds nothing.

The remaining phrases, each distinct one once, are dealt to reference blocks of
about BLOCK_WORDS words by anchor. A block is indexed by the suffix array of
its words. Its phrases that occur once are parsed greedily: the longest match
at a position is the next factor. A factor of ``window`` words or more is a
duplicate span; a window that straddles its end may match elsewhere, so the
parse goes on with the first such window, not behind the factor. Matches in a
block are of words, not of hashes.

An anchor of more than HOT phrases (a line that a third of all documents share,
in ever other surroundings) would not fit a block: its phrases are dealt anew by
the 128-bit key of each window, and a window met twice is a factor of ``window``
words. The factors joined are the duplicate spans, the same either way.

Tables of keys are aggregated before they are shuffled and no group without a
bound is gathered: a passage that a third of all documents share is one phrase
with a count. A phrase's key is 64 bits of its anchor and 64 of all its words.

Cases: null and empty texts have no words, nothing removed; a text of fewer
than ``window`` words keeps them all; repeated rows are copies of each other;
null ids are rows of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_rows, staged

WINDOW = 35
SEED = 10
#: Words of a reference block, about; and the phrases of one anchor beyond which its windows are dealt one by one.
BLOCK_WORDS, HOT = 100_000, 1000
#: Words a task keeps the hashes of.
WORDS_KEPT = 200_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """XXH64 of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, exponents 0 to n."""
    def run(b: int) -> np.ndarray:
        out = np.full(n + 1, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Hashes of word ranges of one sequence, by prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, which: int):
        n = max(1024, 1 << int(len(values)).bit_length())
        self.up, down = _powers(_BASES[which], n)
        own = values if which == 0 else _mix(values + np.uint64(0x632BE59BD9B4E019))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * down[1 : len(own) + 1], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[end] + (end - start).astype(np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its least, the first of equals."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[:-step], at[step:]
        at, size = np.where(values[b] < values[a], b, a), size + step
    return at


def phrases(values: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, phrase hash, first window, number of windows) of each phrase of a sequence of word hashes."""
    n = len(values) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    roll = _Rolling(values, 0)
    k = np.arange(len(values) - seed + 1)
    grams = roll.of(k, k + seed)
    anchors = least(grams, window - seed + 1)
    first = np.flatnonzero(np.concatenate(([True], np.diff(anchors) != 0)))
    count = np.diff(np.concatenate((first, [n])))
    return grams[anchors[first]], roll.of(first, first + count + window - 1), first, count


def word_hashes(words: list[bytes], known: dict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


PARSED = "rid long, n_words long, kept_sha256 string, anchors array<long>, phrases array<long>, counts array<int>"


def parse(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document (rid, text) with its words counted and its phrases; the first window of a phrase is the sum of the counts before it."""

    def make():
        known = _Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, digests, anchors, hashes, counts, at = [], [], [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                a, h, _, c = phrases(word_hashes(words, known), window)
                anchors.append(a)
                hashes.append(h)
                counts.append(c)
                at.append(at[-1] + len(a))
            ends = pa.array(at, pa.int32())
            return batch_of(
                rid=batch.column(0), n_words=pa.array(n_words, pa.int64()), kept_sha256=pa.array(digests),
                anchors=pa.ListArray.from_arrays(ends, _long(np.concatenate(anchors))),
                phrases=pa.ListArray.from_arrays(ends, _long(np.concatenate(hashes))),
                counts=pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts), pa.int32())),
            )

        return step

    return map_rows(texts.select("rid", "text"), make, PARSED)


#: What is known of a phrase of a document: the whole occurs elsewhere; it does,
#: and this occurrence stands for it in its block; it is to be factored.
WHOLE, SHOWN, SOUGHT = 1, 2, 3


def _marks(parsed: DataFrame) -> DataFrame:
    """(rid, marks, edges): for each document the phrases (their numbers, kinds, and whether their anchor is hot) that may hold duplicate windows, and how many are not wholes."""
    shared = parsed.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("all")).filter("all > 1").select("anchor")
    # Each side of a join on a key that may be hot is a table, so that the join can split the key's rows among tasks.
    shared = staged(shared, "anchors")
    each = parsed.select("rid", F.posexplode(F.arrays_zip("anchors", "phrases")).alias("k", "p"))
    placed = each.select("rid", "k", F.col("p.anchors").alias("anchor"), F.col("p.phrases").alias("phrase"))
    placed = staged(placed.join(shared, "anchor"), "occurrences")
    table = staged(placed.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("rid", "k")).alias("first")), "phrases")
    kinds = staged(table.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    known = staged(table.join(kinds, "anchor"), "known")
    stands = (F.col("kinds") > 1) & (F.col("first.rid") == F.col("rid")) & (F.col("first.k") == F.col("k"))
    kind = F.when((F.col("n") == 1) & (F.col("kinds") > 1), SOUGHT).when(stands, SHOWN).when(F.col("n") > 1, WHOLE)
    mark = F.struct(F.col("k").cast("int").alias("k"), kind.cast("int").alias("kind"), (F.col("kinds") > HOT).alias("hot"))
    found = placed.join(known, ["anchor", "phrase"]).select("rid", mark.alias("mark")).filter("mark.kind is not null")
    return found.groupBy("rid").agg(F.collect_list("mark").alias("marks"), F.count_if(F.col("mark.kind") != WHOLE).alias("edges"))


EXCERPTS = "rid long, at int, anchor long, sought boolean, hot boolean, words binary"


def _excerpts(marked: DataFrame, window: int) -> DataFrame:
    """The words of the phrases to be shown or sought."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]
            for rid, text, counts, anchors, marks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                words = text.split()
                first = np.concatenate(([0], np.cumsum(counts))).tolist()
                for m in marks:
                    if m["kind"] != WHOLE:
                        k = m["k"]
                        row = rid, first[k], anchors[k], m["kind"] == SOUGHT, m["hot"], b" ".join(words[first[k] : first[k + 1] + window - 1])
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in EXCERPTS.split(", ")])

        return step

    return map_rows(marked.select("rid", "text", "counts", "anchors", "marks"), make, EXCERPTS)


class Block:
    """A reference block: phrases end to end, and the suffix array of their windows.

    Suffixes are ranked by their first 1, 2, 4, ... words in turn, as far as a
    phrase reaches; a phrase ends with a sign of its own, which nothing matches.
    """

    def __init__(self, phrases: list[list[bytes]], window: int = WINDOW):
        self.window = window
        ids: dict[bytes, int] = {}
        number = len(phrases)
        text = np.fromiter((v for k, p in enumerate(phrases) for v in (*(number + ids.setdefault(w, len(ids)) for w in p), k)), dtype=np.int64)
        sizes = np.fromiter(map(len, phrases), dtype=np.int64, count=number)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.windows = np.maximum(sizes - window + 1, 0)
        self.ranks = [text]
        reach, longest = 1, int(sizes.max(initial=0))
        while reach <= longest:
            now = self.ranks[-1]
            later = np.concatenate((now[reach:], np.full(min(reach, len(now)), -1)))
            self.ranks.append(np.unique(now * (int(now.max()) + 2) + later + 1, return_inverse=True)[1])
            reach *= 2
        at = np.repeat(self.starts - np.cumsum(self.windows) + self.windows, self.windows) + np.arange(int(self.windows.sum()))
        self.order = at[np.argsort(self.ranks[-1][at], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and at b begin with alike."""
        out, last = np.zeros(len(a), dtype=np.int64), len(self.ranks[0]) - 1
        for level in range(len(self.ranks) - 1, -1, -1):
            x, y = np.minimum(a + out, last), np.minimum(b + out, last)
            out += (self.ranks[level][x] == self.ranks[level][y]).astype(np.int64) << level
        return out

    def longest(self) -> np.ndarray:
        """For each place of the text the length of its longest match at another window's place (0 where no window starts)."""
        out = np.zeros(len(self.ranks[0]), dtype=np.int64)
        if len(self.order) > 1:
            a, b = self.order[:-1], self.order[1:]  # the longest match is a neighbour in the suffix array
            size = self.common(a, b)
            out[a] = size
            out[b] = np.maximum(out[b], size)
        return out

    def factors(self, sought: list[int]) -> list[list[tuple[int, int]]]:
        """The greedy parse of each of these phrases: its factors of ``window`` words or more, as (first word, number of words)."""
        match, out = self.longest(), []
        for k in sought:
            own = match[self.starts[k] : self.starts[k] + self.windows[k]].tolist()
            found, i = [], 0
            while i < len(own):
                if own[i] >= self.window:
                    found.append((i, own[i]))
                    i += own[i] - self.window + 1  # the first window that straddles the factor's end
                else:
                    i += 1
            out.append(found)
        return out


FACTORS = "rid long, at int, words int"


def _factors(excerpts: DataFrame, window: int) -> DataFrame:
    """The factors of the phrases sought, from the reference blocks of their anchors."""
    cold = excerpts.filter("not hot")
    n = cold.count()
    blocks = max(1, n * (2 * window - SEED) // BLOCK_WORDS)

    def parsed(table: pa.Table) -> pa.Table:
        sought = np.flatnonzero(np.asarray(table.column("sought"))).tolist()
        block = Block([w.split(b" ") for w in table.column("words").to_pylist()], window)
        rid, at = table.column("rid").to_pylist(), table.column("at").to_pylist()
        rows = [(rid[k], at[k] + a, n) for k, found in zip(sought, block.factors(sought), strict=True) for a, n in found]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["rid", "at", "words"])

    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks))
    return cold.select(block.alias("block"), "rid", "at", "sought", "words").groupBy("block").applyInArrow(parsed, FACTORS)


WINDOWS = "rid long, at int, sought boolean, w1 long, w2 long"


def _hot_factors(excerpts: DataFrame, window: int) -> DataFrame:
    """Likewise for phrases of hot anchors: their windows, dealt by key."""

    def make():
        known = _Hashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for rid, first, sought, words in zip(*(batch.column(c).to_pylist() for c in ("rid", "at", "sought", "words")), strict=True):
                values = word_hashes(words.split(b" "), known)
                at = np.arange(len(values) - window + 1)
                keys = [_Rolling(values, w).of(at, at + window) for w in (0, 1)]
                for p, x in zip(parts, (np.full(len(at), rid), first + at, np.full(len(at), sought), *keys), strict=True):
                    p.append(x)
            rid, at, sought, w1, w2 = (np.concatenate(p) for p in parts)
            return batch_of(rid=pa.array(rid, pa.int64()), at=pa.array(at, pa.int32()), sought=pa.array(sought, pa.bool_()), w1=_long(w1), w2=_long(w2))

        return step

    shown = staged(map_rows(excerpts.filter("hot").select("rid", "at", "sought", "words"), make, WINDOWS), "windows")
    twice = shown.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.bool_or("sought").alias("any")).filter("n > 1 and any").select("w1", "w2")
    return shown.filter("sought").join(twice, ["w1", "w2"], "left_semi").select("rid", "at", F.lit(window).alias("words"))


SPANS = "rid long, n_removed long, spans array<int>"


def _spans(rows: DataFrame, window: int) -> DataFrame:
    """The union of the factors of each document: word intervals, flat and ascending."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = []
            for rid, counts, marks, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                own = [m["k"] for m in marks or () if m["kind"] != SOUGHT]
                more = np.array([(f["at"], f["at"] + f["words"]) for f in found or ()], dtype=np.int64).reshape(-1, 2)
                at = np.concatenate((first[own], more[:, 0]))
                until = np.concatenate((first[[k + 1 for k in own]] - 1 + window, more[:, 1]))
                flat = union(at, until)
                out.append([rid, int((flat[1::2] - flat[::2]).sum()), flat.tolist()])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SPANS.split(", ")])

        return step

    return map_rows(rows.select("rid", "counts", "marks", "found"), make, SPANS)


def union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of the intervals, flat and ascending."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return np.stack((start[new], reach[np.concatenate((new[1:] - 1, [len(start) - 1]))]), axis=1).ravel()


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with ids ``rid``, their parse into phrases, the duplicate spans of those that have any)."""
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.monotonically_increasing_id()), "texts")
    parsed = staged(parse(texts, window), "parsed")
    marks = staged(_marks(parsed), "marks")
    edges = marks.filter("edges > 0").select("rid", "marks")
    marked = texts.select("rid", "text").join(edges.join(parsed.select("rid", "counts", "anchors"), "rid"), "rid")
    excerpts = staged(_excerpts(marked, window), "excerpts")
    factors = _factors(excerpts, window).unionByName(_hot_factors(excerpts, window))
    found = factors.groupBy("rid").agg(F.collect_list(F.struct("at", "words")).alias("found"))
    rows = parsed.select("rid", "counts").join(marks.select("rid", "marks"), "rid").join(found, "rid", "left")
    return texts, parsed, _spans(rows, window).filter("n_removed > 0")


def remove_duplicates(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the words left."""
    texts, parsed, spans = duplicate_spans(docs, window)
    spans = staged(spans, "spans")
    partly = texts.select("rid", "text").join(spans.join(parsed.select("rid", "n_words"), "rid").filter("n_removed < n_words"), "rid")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rid, text, spans = (batch.column(c) for c in ("rid", "text", "spans"))
            digests = [hashlib.sha256(b" ".join(cut(t.as_py().split(), s))).hexdigest() for t, s in zip(text.cast(pa.binary()), spans.to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([rid, pa.array(digests)], names=["rid", "cut"])

        return step

    cuts = map_rows(partly.select("rid", "text", "spans"), make, "rid long, cut string")
    none = hashlib.sha256(b"").hexdigest()
    known = spans.select("rid", "n_removed").join(cuts, "rid", "left").withColumn("cut", F.coalesce("cut", F.lit(none)))
    rows = texts.select("rid", "doc_id").join(parsed.select("rid", "n_words", "kept_sha256"), "rid").join(known, "rid", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut", "kept_sha256").alias("kept_sha256"))


def cut(words: list[bytes], spans: list[int]) -> list[bytes]:
    """The words outside the intervals."""
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out += words[last:a]
        last = b
    return out + words[last:]
