"""Sharding by minimax contiguous partition, with DataFrame functions only.

Groups of equal texts are atomic. They stand in a fixed order: groups of at
least the mean load of the shards left come first, largest first, and get a
shard each (no cut can split them); all others follow by text hash. Over this
order the smallest feasible shard capacity is found by binary search, each
candidate checked greedily, and the order is cut there.

The order is never gathered. Its prefix sums are read at two levels: sums of
2**CELL_BITS hash cells (a table of fixed size), then, for the few cells in
which a cut falls, the sums of as many sub-cells, and so on until a cell has
few groups. The driver sees only these fixed-size summaries.

Cases: a null text counts as an empty one (size 8, crc32 0); an empty table
gives no rows; with fewer groups than shards some shards stay empty; repeated
rows and null ids are rows of their own and get slots of their own; other
columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

CELL_BITS = 12
#: Rows of one numbering cell, about.
SLOT_ROWS = 20_000
ROW_COST = 8


@dataclass(frozen=True)
class _Span:
    """A hash cell of the order: its prefix sums, and whether it is one group."""

    start: int
    end: int
    bits: int
    prefix: int
    whole: bool

    def first_hash(self) -> int:
        return self.prefix << (64 - self.bits)


class _Order:
    """The ordered groups as spans, split where a search needs it."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.spans = self._split([_Span(0, 0, 0, 0, False)])
        self.ends = [s.end for s in self.spans]

    def _split(self, spans: list[_Span]) -> list[_Span]:
        """The spans, all of one width, cut into cells of CELL_BITS more bits, by one query."""
        bits = spans[0].bits
        wide = min(64, bits + CELL_BITS)
        number = F.shiftrightunsigned("h", 64 - wide) if wide < 64 else F.col("h")
        rows = self.groups
        if bits:
            rows = rows.filter(F.shiftrightunsigned("h", 64 - bits).isin([s.prefix for s in spans]))
        found = rows.groupBy(number.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found = sorted((_unsigned(r["cell"]) if wide == 64 else r["cell"], r["size"], r["n"]) for r in found)
        starts, out = {s.prefix: s.start for s in spans}, []
        for cell, size, n in found:
            own = cell >> (wide - bits)
            out.append(_Span(starts[own], starts[own] + size, wide, cell, n == 1))
            starts[own] += size
        return out

    def refine(self, at: set[int]) -> None:
        """Split the spans at these places, one query for each width among them."""
        by_bits: dict[int, list[_Span]] = {}
        for k in at:
            by_bits.setdefault(self.spans[k].bits, []).append(self.spans[k])
        gone = {s for group in by_bits.values() for s in group}
        made = [x for group in by_bits.values() for x in self._split(group)]
        self.spans = sorted([s for s in self.spans if s not in gone] + made, key=lambda s: s.start)
        self.ends = [s.end for s in self.spans]

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int] | None, set[int]]:
        """Fill one shard after the other: the spans where a new one begins, or None if it takes too many.

        A cut inside an unsplit span is put at its start, or, if hopeful, at the
        full capacity: the first never fits too much, the second never too
        little. The unsplit spans met are returned as well.
        """
        at, cuts, open_ = 0, [], set()
        for _ in range(shards):
            k = bisect.bisect_right(self.ends, at + capacity)
            if k == len(self.spans):
                return cuts, open_
            if self.spans[k].whole:
                at = self.spans[k].start
            else:
                open_.add(k)
                at = at + capacity if hopeful else max(at, self.spans[k].start)
            cuts.append(k)
        return None, open_

    def feasible(self, capacity: int, shards: int) -> bool:
        while True:
            fits, a = self.greedy(capacity, shards, False)
            if fits is not None:
                return True
            fits, b = self.greedy(capacity, shards, True)
            if fits is None:
                return False
            self.refine(a | b)

    def cut(self, capacity: int, shards: int) -> list[int]:
        while True:
            cuts, open_ = self.greedy(capacity, shards, False)
            if not open_:
                return [self.spans[k].first_hash() for k in cuts or []]
            self.refine(open_)


def minimax_cuts(groups: DataFrame, shards: int, largest: int) -> list[int]:
    """Hashes (unsigned) at which a new shard begins, for the smallest feasible capacity."""
    order = _Order(groups)
    total = order.ends[-1] if order.ends else 0
    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)
    while low < high:
        middle = (low + high) // 2
        if order.feasible(middle, shards):
            high = middle
        else:
            low = middle + 1
    return order.cut(high, shards)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _unsigned(x: int) -> int:
    return x + (1 << 64) if x < 0 else x


def heavy_groups(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Hashes of the groups that fill a shard alone, largest first, and the size of the largest other.

    A group counts if it has at least the mean load of the shards left without
    the larger ones; there are fewer than ``shards`` such groups.
    """
    top = groups.orderBy(F.desc("size"), "h").limit(shards).collect()
    rest, taken = groups.agg(F.sum("size").alias("s")).first()["s"] or 0, []
    for r in top:
        if len(taken) + 1 >= shards or r["size"] * (shards - len(taken)) < rest:
            break
        taken.append(r["h"])
        rest -= r["size"]
    left = top[len(taken) :]
    return taken, left[0]["size"] if left else 0


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = staged(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + ROW_COST).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-slim",
    )
    groups = staged(slim.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    heavy, largest = heavy_groups(groups, shards)
    rest = groups.filter(~F.col("h").isin(heavy)) if heavy else groups
    cuts = minimax_cuts(rest, shards - len(heavy), largest)

    # Unsigned order of h, as a signed one.
    at = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    shard = F.lit(len(heavy))
    for c in cuts:
        shard = shard + (at >= F.lit(_signed(c ^ (1 << 63)))).cast("int")
    for k, h in enumerate(heavy):
        shard = F.when(F.col("h") == F.lit(h), F.lit(k)).otherwise(shard)
    placed = slim.withColumn("shard", shard.cast("int"))
    return number_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots from 0 within each shard, without gathering a shard.

    Rows fall into cells by a hash of their stored row number, so equal rows
    spread as well; a cell's rows are numbered by a window, and its first slot
    is the count of the cells before it. The number of cells follows the row
    count.
    """
    cells = max(1, -(-placed.count() // SLOT_ROWS))
    celled = placed.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(cells)).cast("int"))
    counts = celled.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "cell").orderBy("rid")
    numbered = celled.withColumn("k", F.row_number().over(own)).join(firsts, ["shard", "cell"])
    return numbered.withColumn("slot", (F.col("first") + F.col("k") - 1).cast("long"))
