"""Timeline verbs: list, get, previous run, and the row shapes they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import Filter
from ..schema import duration_ms
from .running import time_block


def newest() -> list[Column]:
    """Timeline order, newest first; unknown times come last."""
    return [F.col("started_ms").desc(), F.col("id").desc()]


def oldest() -> list[Column]:
    return [F.col("started_ms").asc(), F.col("id").asc()]


def summary(commands: DataFrame) -> DataFrame:
    """The listing's columns; absent text reads as empty, output is never read."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("cwd", "machine", "host", "note")]
    return commands.select("id", "session_id", "cmd", blank[0], "exit_code", "started_ms", "ended_ms", *blank[1:])


def recent(commands: DataFrame, where: Filter = Filter()) -> DataFrame:
    """The newest rows that pass the filter: a top-k, no full sort."""
    return summary(where.apply(commands)).orderBy(*newest()).limit(where.rows())


def newest_then_oldest_first(commands: DataFrame, where: Filter = Filter()) -> DataFrame:
    """The newest N, oldest first, with full rows, for exports."""
    return where.apply(commands).orderBy(*newest()).limit(where.rows()).orderBy(*oldest())


def get(commands: DataFrame, n: int) -> DataFrame:
    """Row of id n, or for n <= 0 the (-n)th newest; 0 and -1 are both the latest. Empty if there is none."""
    if n > 0:
        return commands.filter(F.col("id") == n)
    return commands.orderBy(*newest()).offset(max(-n - 1, 0)).limit(1)


def previous_run(commands: DataFrame, before_id: int) -> DataFrame:
    """The latest earlier row of the same command that was not imported from a history."""
    anchor = commands.filter(F.col("id") == before_id).select(F.col("cmd").alias("a_cmd"), F.col("started_ms").alias("a_ms"), F.col("id").alias("a_id"))
    earlier = (F.col("started_ms") < F.col("a_ms")) | ((F.col("started_ms") == F.col("a_ms")) & (F.col("id") < F.col("a_id")))
    found = commands.filter(recorded()).join(F.broadcast(anchor), (F.col("cmd") == F.col("a_cmd")) & earlier)  # the anchor is one row
    return found.drop("a_cmd", "a_ms", "a_id").orderBy(*newest()).limit(1)


def recorded() -> Column:
    """Not imported from a history file."""
    return F.col("machine").isNull() | ~F.col("machine").startswith("hist:")


def previous_runs(commands: DataFrame, block_ms: int = 86_400_000) -> DataFrame:
    """(id, prev_id) for every row: a strict as-of self join, without a join of rows.

    A command may hold any share of all rows, so its rows are cut into blocks of
    time, or of ids where the time is unknown: within a block a window looks back; a block's first rows take the last
    recorded row of the blocks before, from a table of one row per block.
    """
    slim = commands.select("id", "cmd", "started_ms", recorded().alias("own")).withColumn("block", time_block(block_ms))
    within = Window.partitionBy("cmd", "block").orderBy("started_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    near = slim.withColumn("near", F.last(F.when(F.col("own"), F.col("id")), ignorenulls=True).over(within))
    lasts = slim.filter("own").groupBy("cmd", "block").agg(F.max(F.struct("started_ms", "id")).getField("id").alias("last"))
    every = slim.select("cmd", "block").distinct().join(lasts, ["cmd", "block"], "left")
    over = Window.partitionBy("cmd").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = every.select("cmd", "block", F.last("last", ignorenulls=True).over(over).alias("far"))
    return near.join(far, ["cmd", "block"]).select("id", F.coalesce("near", "far").alias("prev_id"))


def web_row(commands: DataFrame) -> DataFrame:
    """The API's row: unknown durations are -1, negative ones stay."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return commands.select(
        "id", "session_id", "cmd", text("cwd"), F.col("exit_code").alias("exit"), F.col("started_ms").alias("started_at"),
        F.coalesce(duration_ms(), F.lit(-1).cast("long")).alias("dur_ms"), text("host"), text("note"),
        F.coalesce(F.col("machine").startswith("hist:"), F.lit(False)).alias("hist"),
    )


def ignored(cmd: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns is found in the command."""
    if not patterns:
        return F.lit(False)
    return F.rlike(cmd, F.lit("|".join(f"(?:{p})" for p in patterns)))


def without_ignored(commands: DataFrame, patterns: list[str]) -> DataFrame:
    return commands.filter(~ignored(F.col("cmd"), patterns))


def picker_feed(commands: DataFrame, where: Filter = Filter(limit=1000)) -> DataFrame:
    """id, a tab, and a line to show; newest first."""
    mark = F.when(F.col("exit_code").isNull(), "?").when(F.col("exit_code") == 0, " ").otherwise("!")
    line = F.format_string("%d\t%s %s", F.col("id"), mark, F.replace(F.col("cmd"), F.lit("\n"), F.lit(" ⏎ ")))
    return recent(commands, where).select("id", "started_ms", line.alias("line"))
