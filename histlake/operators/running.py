"""Global ranks and running sums without gathering the table in one task.

Rows fall into ordered buckets; bucket totals (few rows) are summed in order,
and within a bucket a window does the rest. The window of bucket totals is the
only single-task step, over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_running(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to and including this one, by bucket, then order."""
    keyed = df.withColumn("__b", bucket).withColumn("__v", value)
    totals = keyed.groupBy("__b").agg(F.sum("__v").alias("__t"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(starts, "__b").withColumn(name, F.col("__s") + F.sum("__v").over(own)).drop("__b", "__v", "__s")


def with_rank(df: DataFrame, key: str, name: str, width: int = 4096) -> DataFrame:
    """Adds ``name``: the number of rows before this one by an integer key, from 0."""
    ranked = with_running(df, F.floor(F.col(key) / width), [F.col(key)], F.lit(1).cast("long"), name)
    return ranked.withColumn(name, F.col(name) - 1)


def time_block(width_ms: int, ids: int = 65_536) -> Column:
    """Ordered buckets of rows by start and id: spans of time, and before them runs of ids where the time is unknown.

    Bulk imports leave any number of rows at time 0, which no task should hold at once.
    """
    known = F.col("started_ms") > 0
    part = F.when(known, F.floor(F.col("started_ms") / width_ms)).otherwise(F.floor(F.col("id") / ids))
    return F.struct(known.alias("known"), part.alias("part"))
