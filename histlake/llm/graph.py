"""Connected components of a link table, by alternating star contraction.

Each round is two joins on pre-aggregated minima, written to the shared folder;
the number of rounds follows the logarithm of the longest chain. Nothing is
gathered: a hub's links are split among tasks by the skew handling of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mark(edges: DataFrame) -> tuple:
    """The number of links and two sums of their 64-bit hashes: equal only for equal tables."""
    sums = [F.sum(F.xxhash64(*own).cast("decimal(38,0)")) for own in (("u", "v"), ("v", "u"))]
    return tuple(edges.agg(F.count("*"), *sums).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b: long) whose root is another node.

    The root is the least node of the component.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
