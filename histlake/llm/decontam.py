"""Benchmark decontamination with a distributed positional inverted index.

Training documents are indexed in segments, as a search engine does: a segment
is a run of documents with, for every term, the ascending positions of its
tokens. Segments are written once to the shared folder; a search reads them
where they lie, takes the lists of the test terms, and shuffles nothing. A
phrase is found by intersecting the offset-adjusted lists of its terms, rarest
first. Terms within SPAN words, in any order, are found likewise: the lists are
narrowed around the rarest term's tokens, then each run of words is tried.

Test items are broadcast in blocks of at most BLOCK_WORDS windows, cut within an
item where need be, so neither the test set nor an item has a bound.

Cases: null and empty texts have no words, on either side; an item of fewer
than ``width`` words is one window; items of one id count once; a null item id
reads as an empty one; repeated documents and null ids are rows of their own;
empty tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, prepare, release, row_hash, staged, text_bytes, unused

WIDTH = 13
SEGMENT_WORDS = 2_000_000
BLOCK_WORDS = 200_000
#: Words that a proximity match may take up.
SPAN = 26
#: Empty positions between documents, so that no phrase or run of SPAN words crosses them.
GAP = 64

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_TABLE).split()


SEGMENT = "doc_ids array<long>, row_keys array<long>, starts array<int>, lengths array<int>, terms array<binary>, counts array<int>, positions binary"
_SEGMENT = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("row_keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())),
    ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary()),
])


class _Builder:
    """Gathers documents and yields them as one segment row."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.ids, self.keys, self.starts, self.lengths, self.next = [], [], [], [], 0
        self.terms: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []

    def add(self, doc_id: int | None, key: int, text: bytes) -> None:
        own, terms = words(text), self.terms
        for w in set(own).difference(terms):
            terms[w] = len(terms)
        self.codes.append(np.fromiter(map(terms.__getitem__, own), dtype=np.int32, count=len(own)))
        self.ids.append(doc_id)
        self.keys.append(key)
        self.starts.append(self.next)
        self.lengths.append(len(own))
        self.next += len(own) + GAP

    def row(self) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(self.lengths)) * GAP, self.lengths)
        counts = np.bincount(codes, minlength=len(self.terms)).tolist()
        values = [self.ids, self.keys, self.starts, self.lengths, list(self.terms), counts, at[np.argsort(codes, kind="stable")].astype("<i4").tobytes()]
        out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SEGMENT.types, strict=True)], schema=_SEGMENT)
        self.reset()
        return out


def build_index(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text); ``row`` tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build = _Builder()
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                build.add(doc_id, key, text)
                if build.next >= SEGMENT_WORDS:
                    yield build.row()
        if build.ids:
            yield build.row()
        release()

    prepare(docs.sparkSession)
    key = F.lit(0).cast("long") if row is None else row
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("row_key"), "text").mapInArrow(run, SEGMENT)
    return staged(rows.withColumn("segment", F.monotonically_increasing_id()), "postings")


class Segment:
    """One segment's lists of the wanted terms, and searches over them."""

    def __init__(self, batch: pa.RecordBatch, k: int, wanted: pa.Array):
        own = {name: batch.column(name)[k] for name in ("starts", "counts", "terms", "positions")}
        self.starts = own["starts"].values.to_numpy()
        positions = np.frombuffer(own["positions"].as_buffer(), dtype="<i4")
        ends = np.cumsum(own["counts"].values.to_numpy(), dtype=np.int64)
        terms = own["terms"].values
        held = np.flatnonzero(pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False))
        first = np.concatenate(([0], ends))[held].tolist()
        self.lists = {t: positions[a:b] for t, a, b in zip(terms.take(pa.array(held)).to_pylist(), first, ends[held].tolist(), strict=True)}

    def phrase(self, terms: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the terms stand one after the other."""
        try:
            lists = sorted(((self.lists[t], k) for k, t in enumerate(terms)), key=lambda x: len(x[0]))
        except KeyError:
            return np.zeros(0, dtype=np.int32)
        at = lists[0][0] - np.int32(lists[0][1])
        for positions, k in lists[1:]:
            if not len(at):
                break
            want = at + np.int32(k)
            place = np.searchsorted(positions, want)
            place[place == len(positions)] = 0
            at = at[positions[place] == want]
        return at

    def near(self, terms: tuple[bytes, ...], span: int = SPAN, known: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the documents in which all terms stand, in any order, within ``span`` (at most GAP) words.

        ``known`` holds documents that need not be looked at.
        """
        try:
            lists = sorted((self.lists[t] for t in set(terms)), key=len)
        except KeyError:
            return np.zeros(0, dtype=np.int64)
        at = lists[0]
        for positions in lists[1:]:
            place = np.searchsorted(positions, at - np.int32(span - 1))
            place[place == len(positions)] = 0
            at = at[np.abs(positions[place] - at) < span]
            if not len(at):
                return np.zeros(0, dtype=np.int64)
        docs = self.document(at)
        if known is not None and len(known):
            left = ~np.isin(docs, known)
            at, docs = at[left], docs[left]
        found: set[int] = set()
        for d, p in zip(docs.tolist(), at.tolist(), strict=True):
            if d not in found:
                own = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)].tolist() for x in lists]
                if any(all(any(s <= x < s + span for x in o) for o in own) for s in {x for o in own for x in o if x <= p}):
                    found.add(d)
        return np.fromiter(sorted(found), dtype=np.int64, count=len(found))

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def windows(item: bytes, width: int) -> Iterator[tuple[bytes, ...]]:
    own = words(item)
    for k in range(max(1, len(own) - width + 1) if own else 0):
        yield tuple(own[k : k + width])


def blocks(benchmark: DataFrame, width: int) -> Iterator[tuple[list[str], dict[tuple[bytes, ...], list[int]]]]:
    """The items in blocks of at most BLOCK_WORDS windows: their ids, and the items of each window."""
    ids: list[str] = []
    found: dict[tuple[bytes, ...], list[int]] = {}
    size = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        ids.append(r["i"])
        for w in windows(bytes(r["t"] or b""), width):
            if size >= BLOCK_WORDS:
                yield ids, found
                ids, found, size = [r["i"]], {}, 0
            own = found.setdefault(w, [])
            if not own or own[-1] != len(ids) - 1:
                own.append(len(ids) - 1)
            size += 1
    yield ids, found


MATCHES = "doc_id long, row_key long, segment long, ordinal int, n_words long, covered array<int>, items array<string>, near_items array<string>"


def _search(index: DataFrame, ids: list[str], found: dict[tuple[bytes, ...], list[int]]) -> DataFrame:
    """For every document of the index: the word intervals hit (start, end, start, ...), the items, and those met by proximity."""
    sc = index.sparkSession.sparkContext
    shared = sc.broadcast((ids, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = shared.value
        wanted = pa.array(sorted({t for w in found for t in w}), pa.binary())
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch, k, wanted)
                doc_ids, keys, lengths = (batch.column(c)[k].values for c in ("doc_ids", "row_keys", "lengths"))
                n = len(doc_ids)
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                for window, own in found.items():
                    at = segment.phrase(window)
                    names = [ids[k] for k in own]
                    docs = segment.document(at)
                    for d, a in zip(docs.tolist(), (at - segment.starts[docs]).tolist(), strict=True):
                        spans.setdefault(d, []).append((a, a + len(window)))
                        items.setdefault(d, set()).update(names)
                    for d in segment.near(window, SPAN, docs).tolist():
                        near.setdefault(d, set()).update(names)
                columns = [
                    doc_ids, keys, pa.array([batch.column("segment")[k].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), lengths.cast(pa.int64()),
                    pa.array([merged(spans.get(d, [])) for d in range(n)], pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    pa.array([sorted(near.get(d, set()) | items.get(d, set())) for d in range(n)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in MATCHES.split(", ")])
        release()

    return index.mapInArrow(run, MATCHES)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of the intervals, flat and ascending."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


_DIGEST = "doc_id long, row_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"


def _digest(matches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("n_words").to_pylist()
            hit, count, digest, near = [], [], [], []
            for spans, items, close in zip(*(batch.column(c).to_pylist() for c in ("covered", "items", "near_items")), strict=True):
                flat = merged(list(zip(spans[::2], spans[1::2], strict=True)))
                own = sorted(set(items))
                hit.append(sum(flat[1::2]) - sum(flat[::2]))
                count.append(len(own))
                digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                near.append(len(set(close)))
            dirty = [h > 0 and 20 * h >= n for h, n in zip(hit, n_words, strict=True)]
            cols = [batch.column("doc_id"), batch.column("row_key"), pa.array(n_words), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(dirty), pa.array(near, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _DIGEST.split(", ")])

    return matches.mapInArrow(run, _DIGEST)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, row: Column | None = None) -> DataFrame:
    """One row per document: where test windows stand (``covered``), the items met exactly, and those met within SPAN words."""
    index = build_index(docs, row)
    first, *more = (_search(index, *part) for part in blocks(benchmark, width))
    if not more:
        return first
    found = reduce(DataFrame.unionByName, more, first)
    return staged(found, "matches").groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("covered", "items", "near_items")],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, row: Column | None = None) -> DataFrame:
    """One row per document: its words, the words inside test windows, the items met, the verdict, and the items met by proximity."""
    return _digest(matches(docs, benchmark, width, row))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    found = decontaminate(docs, benchmark, row=row_hash(docs)).filter("contaminated")
    own_key, id_name, key_name = unused(docs, "__key", "__dirty_id", "__dirty_key")
    dirty = staged(found.select(F.col("doc_id").alias(id_name), F.col("row_key").alias(key_name)).distinct(), "dirty")
    keyed = docs.withColumn(own_key, row_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.col(own_key) == F.col(key_name))
    return keyed.join(dirty, same, "left_anti").select(*own_columns(docs))
