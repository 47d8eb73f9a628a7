"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints (64 bits, by majority over the hashes of 3-word shingles) are
linked at DISTANCE or fewer differing bits. Cut into six blocks, a close pair
agrees on some three of them, so every fingerprint enters the 20 tables of
three blocks, and pairs are sought within a table's bucket only, then verified.

Only distinct fingerprints take part; copies share theirs. A bucket of up to
BUCKET fingerprints is compared directly. A larger one is never gathered: its
fingerprints agree on 32 bits, and the same blocks over the other bits deal
them into buckets that agree on 48 or so. With at most 2**17 values
possible there, these have a fixed bound, and are linked by flooding a bit
table along all masks of DISTANCE bits, without pairs. Buckets hand on a star
of links for each component found, so links are linear in fingerprints.

Cases: texts of fewer than three words have one shingle, their whole sequence;
null, empty and wordless texts have fingerprint zero, linked like any other;
repeated rows and null ids are rows of their own (a null id is never a
component's id unless all its ids are null); an empty table gives no rows;
other columns are ignored by the operator and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, own_columns, row_hash, staged, text_bytes, unused
from .graph import components

DISTANCE = 3
SEED = 42
SHINGLE = 3
BUCKET = 256


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(words) - SHINGLE + 1)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document, and ``row`` if given."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            found = []
            for text in text_bytes(batch.column(1)):
                if text not in known:
                    known[text] = fingerprint(text)
                found.append(known[text])
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column(0), prints, batch.column(2)], names=["doc_id", "fp", "row"])

        return step

    given = docs.select(F.col("doc_id").cast("long"), "text", (F.lit(0).cast("long") if row is None else row).alias("row"))
    found = map_rows(given, make, "doc_id long, fp long, row long")
    return found.drop("row") if row is None else found


def _masks(bits: list[int]) -> list[int]:
    """Masks of the unions of three of six near-equal blocks of these bits."""
    blocks = [[int(b) for b in x] for x in np.array_split(bits, 6)]
    return [sum(1 << b for x in three for b in x) for three in combinations(blocks, DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


FIRST = _masks(list(range(64)))
#: For each first mask, the second masks: they include the first's bits.
SECOND = [[m | s for s in _masks([b for b in range(64) if not m >> b & 1])] for m in FIRST]


def _keyed(masks: list[int]) -> Column:
    """(table, fp under its mask) for each mask."""
    return F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])


def flood(values: np.ndarray) -> np.ndarray:
    """For each distinct 64-bit value, the place of the least value of its component at DISTANCE bits.

    Memory and time are bounded by the number of bits in which the values
    differ at all, or by the square of their number if there are few.
    """
    n = len(values)
    label = np.arange(n)
    if n <= 2048:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= DISTANCE
        a, b = np.nonzero(np.triu(near, 1))
        pairs = lambda: [(a, b)]
    else:
        free = int(np.bitwise_or.reduce(values ^ values[0]))
        bits = [k for k in range(64) if free >> k & 1]
        small = np.zeros(n, dtype=np.int64)
        for k, bit in enumerate(bits):
            small |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
        place = np.full(1 << len(bits), -1, dtype=np.int64)
        place[small] = np.arange(n)
        masks = [sum(1 << k for k in c) for d in range(1, DISTANCE + 1) for c in combinations(range(len(bits)), d)]

        def pairs():
            for m in masks:
                other = place[small ^ m]
                own = np.flatnonzero(other >= 0)
                yield own, other[own]

    while True:
        before = label.copy()
        for a, b in pairs():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _stars(buckets: DataFrame) -> DataFrame:
    """Links (a, b) of the fingerprints (column fps) of each bucket with the least of their component."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            left, right = [], []
            for fps in batch.column(0):
                values = np.unique(np.asarray(fps.values, dtype=np.int64).view(np.uint64))
                label = flood(values)
                own = np.flatnonzero(label != np.arange(len(values)))
                left.append(values[own].view(np.int64))
                right.append(values[label[own]].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

        return step

    return map_rows(buckets.select("fps"), make, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints (column fp) at DISTANCE bits."""
    dealt = distinct.select("fp", F.explode(_keyed(FIRST)).alias("k")).select("fp", "k.t", "k.key")
    buckets = staged(
        dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets"
    )
    two = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    more = dealt.join(buckets.filter("n > 2").select("t", "key", "n"), ["t", "key"])
    direct = more.filter(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    again = F.lit(None)
    for k, masks in enumerate(SECOND):
        again = F.when(F.col("t") == k, _keyed(masks)).otherwise(again)
    large = more.filter(F.col("n") > BUCKET).select("t", "fp", F.explode(again).alias("k")).select("t", "k.*", "fp")
    large = large.toDF("t", "t2", "key", "fp").groupBy("t", "t2", "key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return two.unionByName(_stars(direct)).unionByName(_stars(large))


def _roots(own: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint: the least fingerprint of its component."""
    distinct = staged(own.select("fp").distinct(), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    own = staged(fingerprints(docs), "fingerprints")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = staged(least.join(_roots(own), "fp"), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns kept: the one of the least id.

    Rows of the same id are told apart by a hash of all columns; of rows equal
    in everything one stays. A component without ids keeps the row of the least
    hash.
    """
    own = staged(fingerprints(docs, row_hash(docs)), "fingerprints")
    rooted = own.join(_roots(own), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("row"))
    own_key, id_name, key_name = unused(docs, "__key", "__kept_id", "__kept_key")
    first = rooted.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias(id_name), F.col("first.row").alias(key_name))
    keyed = docs.withColumn(own_key, row_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.col(own_key) == F.col(key_name))
    kept = keyed.join(first, same, "left_semi")
    # Texts are shuffled a second time only if some row occurs more than once.
    if not own.groupBy("doc_id", "row").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", own_key])
    return kept.select(*own_columns(docs))
