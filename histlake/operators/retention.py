"""Pruning, notes, deletions, physical rewrites and reindexing.

The store is Parquet partitioned by day. Notes and deletions are appended to a
mutation log and applied on read, latest first; secrets and pruned rows must
leave the files, so those rewrite the day partitions they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redact import hits, redact
from ..functions.terminal import plain_of
from ..schema import DAY_MS
from .running import time_block, with_running

ROW_COST = 128


def payload(output: str = "output_bytes", plain: str = "plain") -> Column:
    return F.col(output) + F.coalesce(F.octet_length(plain), F.lit(0)) + F.octet_length("cmd") + ROW_COST


def payload_sum(commands: DataFrame) -> DataFrame:
    return commands.agg(F.coalesce(F.sum(payload().cast("long")), F.lit(0)).alias("payload"))


def prune_by_age(commands: DataFrame, cutoff_ms: int, keep_unknown: bool = False) -> DataFrame:
    """The rows kept. Unknown times count as oldest and go, unless asked to stay."""
    kept = F.col("started_ms") >= cutoff_ms
    return commands.filter(kept | (F.col("started_ms") == 0) if keep_unknown else kept)


def prune_plan(commands: DataFrame, excess: int) -> DataFrame:
    """(id, size, running): the rows to delete, oldest first, until ``excess`` bytes are covered.

    The row that crosses the excess is among them. The running sum goes by day,
    and by id where the time is unknown, so no task holds more than a day's rows
    or a run of ids.
    """
    sized = commands.select("id", "started_ms", payload().cast("long").alias("size"))
    run = with_running(sized, time_block(DAY_MS), [F.col("started_ms"), F.col("id")], F.col("size"), "running")
    return run.filter(F.col("running") - F.col("size") < excess).select("id", "size", "running")


def prune_to_size(commands: DataFrame, most: int) -> DataFrame:
    """The rows kept so that the payload is at most ``most``: one total, then one plan."""
    total = payload_sum(commands).first()["payload"]
    return commands if total <= most else commands.join(prune_plan(commands, total - most).select("id"), "id", "left_anti")


def apply_mutations(commands: DataFrame, log: DataFrame) -> DataFrame:
    """The rows with the latest note of each id applied and deleted ids gone. log: (id, at, kind, note), kind note or delete."""
    last = log.groupBy("id").agg(
        F.max_by(F.struct("note"), F.when(F.col("kind") == "note", F.col("at"))).alias("n"), F.bool_or(F.col("kind") == "delete").alias("gone")
    )
    joined = commands.join(last, "id", "left").filter(~F.coalesce("gone", F.lit(False)))
    new = F.when(F.col("n").isNotNull(), F.nullif(F.col("n.note"), F.lit(""))).otherwise(F.col("note"))
    return joined.withColumn("note", new).drop("n", "gone")


def _output_text() -> Column:
    """The text of the raw output, escapes stripped."""
    return plain_of(F.lit(""), F.col("output"))


def redacted(commands: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The rows with secrets masked in command, text, note and raw output; escapes are stripped first.

    Raw output that holds a secret becomes its masked text, without colours; other output stays as it is.
    """
    rows = commands.withColumns({c: redact(F.col(c), extra) for c in ("cmd", "plain", "note") if c in commands.columns})
    if "output" not in commands.columns:
        return rows
    text = _output_text()
    return rows.withColumn("output", F.when(hits(text, extra) > 0, F.encode(redact(text, extra), "UTF-8")).otherwise(F.col("output")))


def redaction_hits(commands: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """A dry run: (id, hits) of the rows that would change. Text and raw output hold the same secrets and count once."""
    plain = hits(F.coalesce("plain", F.lit("")), extra)
    if "output" in commands.columns:
        plain = F.greatest(plain, hits(_output_text(), extra))
    n = hits(F.col("cmd"), extra) + plain + hits(F.coalesce("note", F.lit("")), extra)
    return commands.select("id", n.alias("hits")).filter("hits > 0")


def reindex(commands: DataFrame) -> DataFrame:
    """Derived columns recomputed: missing text from the raw output, and the search copy."""
    plain = plain_of(F.col("plain"), F.col("output"))
    return commands.withColumn("plain", plain).withColumn("plain_lc", F.lower("plain"))


def _files(spark, path: str):
    """The Hadoop class of paths, and the file system of this one."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _side(path: str) -> str:
    return path.rstrip("/") + "__rewrite"


def rewrite_days(spark, path: str, days: list[str], change) -> None:
    """Rewrite the day partitions named; a day without rows afterwards goes, and no old file stays.

    The new partitions are written beside the table, then swapped in by renames.
    A swap that was cut short is finished by ``finish_rewrite``, which every
    rewrite and every opening of a store begins with.
    """
    finish_rewrite(spark, path)
    own = spark.read.parquet(path).filter(F.col("started_day").isin(days))
    change(own).write.mode("overwrite").partitionBy("started_day").parquet(f"{_side(path)}/rows")
    kind, files = _files(spark, path)
    left = [(d, files.exists(kind(f"{_side(path)}/rows/started_day={d}"))) for d in days]
    spark.createDataFrame(left, "day string, kept boolean").coalesce(1).write.mode("overwrite").json(f"{_side(path)}/days")
    finish_rewrite(spark, path)


def rewrite_table(spark, path: str, change) -> None:
    """Likewise for a table without partitions: all of it is written anew and swapped in."""
    finish_rewrite(spark, path)
    swap_in(spark, path, change(spark.read.parquet(path)))


def swap_in(spark, path: str, rows: DataFrame, by: tuple[str, ...] = ()) -> None:
    """The rows as the whole of a table, partitioned by the columns named, written beside it and swapped in."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{_side(path)}/table")
    finish_rewrite(spark, path)


def finish_rewrite(spark, path: str) -> None:
    """Swap in the partitions of a rewrite whose rows are all written; drop what is left of one whose are not."""
    kind, files = _files(spark, path)
    side = _side(path)
    if files.exists(kind(f"{side}/days/_SUCCESS")):  # written last
        for r in spark.read.schema("day string, kept boolean").json(f"{side}/days").collect():
            old, new = kind(f"{path}/started_day={r['day']}"), kind(f"{side}/rows/started_day={r['day']}")
            if not r["kept"]:
                files.delete(old, True)
            elif files.exists(new):  # else it has been swapped in already
                files.delete(old, True)
                files.rename(new, old)
    elif files.exists(kind(f"{side}/table/_SUCCESS")):
        files.delete(kind(path), True)
        files.rename(kind(f"{side}/table"), kind(path))
    files.delete(kind(side), True)
    spark.catalog.refreshByPath(path)


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key: upserts of small state tables."""
    fields = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*fields), at).alias("r")).select(*keys, "r.*")


