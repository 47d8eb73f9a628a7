"""Breakdowns by dimension, global figures and activity histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commandline import command_head
from ..schema import duration_ms, failed, known_start, started_day

BUCKETS = 12
DIMENSIONS = ("cmd", "cwd", "exit", "host", "session", "day")


def overview(commands: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row of global figures; the oldest start includes unknown ones (0)."""
    row = commands.agg(
        F.count("*").alias("commands"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"),
        F.coalesce(F.min("started_ms"), F.lit(0)).alias("oldest_ms"), F.count_if(F.col("machine").isNotNull()).alias("imported"),
    )
    return row if sessions is None else row.crossJoin(F.broadcast(sessions.agg(F.count("*").alias("sessions"))))  # two rows of totals


def group_key(dimension: str, zone: str | None = None) -> Column:
    if dimension == "cmd":
        return command_head(F.col("cmd"))
    if dimension == "cwd":
        return F.coalesce("cwd", F.lit(""))
    if dimension == "exit":
        return F.coalesce(F.col("exit_code").cast("string"), F.lit("?"))
    if dimension == "host":
        return F.when(F.coalesce("host", F.lit("")) == "", "local").otherwise(F.col("host"))
    if dimension == "session":
        return F.when(F.col("session_id") > 0, F.concat(F.lit("#"), F.col("session_id").cast("string"))).otherwise("(imported)")
    if dimension == "day":
        return started_day(zone)
    raise ValueError(f"unknown dimension {dimension!r}; one of {', '.join(DIMENSIONS)}")


def breakdown(commands: DataFrame, dimension: str, top: int = 0, zone: str | None = None) -> DataFrame:
    """key, count, fails, dur_ms and fail_pct of each group, in the dimension's order.

    Days are chronological and a top-N keeps the latest; sessions go by number,
    newest first, imported last; all else by count, then key.
    """
    spent = duration_ms()
    totals = [F.count("*").alias("count"), F.count_if(failed()).alias("fails"), F.coalesce(F.sum(F.when(spent > 0, spent)), F.lit(0)).alias("dur_ms")]
    if dimension == "cmd":  # heads are made of distinct commands only
        each = commands.groupBy("cmd").agg(*totals)
        groups = each.groupBy(group_key("cmd").alias("key")).agg(*[F.sum(c).alias(c) for c in ("count", "fails", "dur_ms")])
    else:
        groups = commands.groupBy(group_key(dimension, zone).alias("key")).agg(*totals)
    groups = groups.withColumn("fail_pct", F.expr("(fails * 100 + count div 2) div count"))
    if dimension == "day":
        return groups.orderBy(F.desc("key")).limit(top).orderBy("key") if top else groups.orderBy("key")
    if dimension == "session":
        order = [F.try_to_number(F.substring("key", 2, 20), F.lit("99999999999999999999")).desc_nulls_last()]
    else:
        order = [F.desc("count"), F.col("key").asc()]
    ordered = groups.orderBy(*order)
    return ordered.limit(top) if top else ordered


def time_range(commands: DataFrame) -> DataFrame:
    """(first, last) known starts; nulls if there are none."""
    return commands.agg(F.min(known_start()).alias("first"), F.max(known_start()).alias("last"))


def bucket(start: str = "started_ms", first: str = "first", last: str = "last") -> Column:
    """The activity bucket of a known start: integer nanosecond arithmetic, in decimals so that no span overflows."""
    at = f"(cast({start} - {first} as decimal(38,0)) * 1000000)"
    span = f"(cast({last} - {first} as decimal(38,0)) * 1000000)"
    return F.expr(f"case when {start} > 0 then case when {last} = {first} then {BUCKETS - 1} else cast({at} * {BUCKETS} div ({span} + 1) as int) end end")


def activity(commands: DataFrame, dimension: str, zone: str | None = None) -> DataFrame:
    """key and its histogram of 12 counts over the whole span; null where no start is known at all."""
    ranged = commands.crossJoin(F.broadcast(time_range(commands)))  # one row
    keyed = ranged.select(group_key(dimension, zone).alias("key"), bucket().alias("b"), F.col("first"))
    counts = [F.count_if(F.col("b") == k).cast("int") for k in range(BUCKETS)]
    spark_array = F.when(F.max("first").isNotNull(), F.array(*counts))
    return keyed.groupBy("key").agg(spark_array.alias("spark"))


GLYPHS = "▁▂▃▄▅▆▇█"


def sparkline(counts: Column) -> Column:
    """One glyph per count, scaled to the largest; a blank for zero."""
    glyphs = F.array(*[F.lit(g) for g in GLYPHS])
    top = F.array_max(counts)
    glyph = lambda n: F.when(n == 0, F.lit(" ")).otherwise(F.element_at(glyphs, (F.floor((n * len(GLYPHS) - 1) / top) + 1).cast("int")))
    return F.array_join(F.transform(counts, glyph), "")
