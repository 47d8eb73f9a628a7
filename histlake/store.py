"""The command store on disk: append, open with migrations, and its tables' layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.redact import hits, redact
from .operators import retention, search
from .plans.filters import Filter
from .schema import COMMANDS, VERSION, started_day, with_search_text


class Store:
    """A folder: ``commands`` partitioned by day and sorted by time in files, ``mutations``, an append-only log, ``version``, and ``postings`` once ``index`` has run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for table in ("commands", "mutations", "postings"):
            retention.finish_rewrite(spark, f"{self.path}/{table}")
        if self.version() > VERSION:
            raise ValueError(f"the store is of version {self.version()}, this library of {VERSION}")

    def version(self) -> int:
        """The schema version the store was last written with, 0 for one without rows."""
        try:
            return self.spark.read.schema("version int").json(f"{self.path}/version").first()["version"]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def append(self, commands: DataFrame) -> None:
        """Add rows; missing columns read as null, derived ones are computed."""
        kinds = {c.split()[0]: c.split()[1] for c in COMMANDS.split(", ")}
        own = with_search_text(commands.withColumn("plain", F.coalesce("plain", F.lit(""))))
        rows = own.select(*[(F.col(c) if c in own.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        day = rows.withColumn("started_day", F.regexp_replace(started_day(), "unknown", "1970-01-01"))
        if self.version() != VERSION:
            self.spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{self.path}/version")
        # A day, and above all the day of unknown times, may hold any share of the rows: large ones are split.
        out = day.hint("rebalance", "started_day").sortWithinPartitions("started_day", "started_ms", "id")
        out.write.mode("append").option("compression", "zstd").partitionBy("started_day").parquet(f"{self.path}/commands")
        if self._has("postings"):
            search.postings(rows).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def raw(self) -> DataFrame:
        return self.spark.read.schema(COMMANDS + ", started_day STRING").parquet(f"{self.path}/commands")

    def mutations(self) -> DataFrame:
        return self.spark.read.schema("id LONG, at LONG, kind STRING, note STRING").parquet(f"{self.path}/mutations")

    def mutate(self, rows: DataFrame) -> None:
        """Notes and deletions: (id, at, kind, note)."""
        rows.write.mode("append").parquet(f"{self.path}/mutations")

    def set_note(self, ident: int, note: str, at: int) -> None:
        """Set a row's note, or clear it with ''. Raises KeyError for an unknown id."""
        if self.raw().filter(F.col("id") == ident).isEmpty():
            raise KeyError(ident)
        self.mutate(self.spark.createDataFrame([(ident, at, "note", note)], "id long, at long, kind string, note string"))

    def delete(self, ident: int, at: int) -> None:
        """Delete a row; an unknown id is no error."""
        self.mutate(self.spark.createDataFrame([(ident, at, "delete", None)], "id long, at long, kind string, note string"))

    def _has(self, table: str) -> bool:
        kind, files = retention._files(self.spark, self.path)
        return files.exists(kind(f"{self.path}/{table}"))

    def commands(self) -> DataFrame:
        """The rows as they stand: mutations applied."""
        return retention.apply_mutations(self.raw(), self.mutations()) if self._has("mutations") else self.raw()

    def index(self) -> None:
        """Write the trigrams of all rows anew; rows appended from then on add theirs. Those of deleted rows go with the next call."""
        retention.swap_in(self.spark, f"{self.path}/postings", search.postings(self.commands()), ("bucket",))

    def search(self, query: str, where: Filter = Filter()) -> DataFrame:
        """``search_ids`` of commands and outputs, through the postings where they are written and the query has a trigram."""
        rows = self.commands()
        if len(query) < search.LEAST_QUERY or not self._has("postings"):
            return search.search_ids(rows.withColumn("note", F.lit("")), query, where)
        own = self.spark.read.schema("tri STRING, id LONG, bucket INT").parquet(f"{self.path}/postings")
        return search.search_by_trigrams(rows, own, query, where)

    def redact(self, extra: list[str] | None = None) -> int:
        """Mask secrets in the files themselves, raw output and the notes of the mutation log included; the number of rows changed."""
        hit = retention.redaction_hits(self.raw(), extra).join(self.raw().select("id", "started_day"), "id")
        days = hit.groupBy("started_day").count().collect()  # one row per day touched
        if days:
            change = lambda rows: with_search_text(retention.redacted(rows, extra))
            retention.rewrite_days(self.spark, f"{self.path}/commands", [d["started_day"] for d in days], change)
            if self._has("postings"):
                self.index()
        return sum(d["count"] for d in days) + self._redact_log(extra)

    def _redact_log(self, extra: list[str] | None) -> int:
        if not self._has("mutations"):
            return 0
        log = self.mutations()
        changed = log.filter(hits(F.coalesce("note", F.lit("")), extra) > 0).count()
        if changed:
            retention.rewrite_table(self.spark, f"{self.path}/mutations", lambda rows: rows.withColumn("note", redact(F.col("note"), extra)))
        return changed


def migrated(rows: DataFrame, version: int) -> DataFrame:
    """Rows of an older schema version with the columns added since; versions only add."""
    if version > VERSION:
        raise ValueError(f"the store is of version {version}, this library of {VERSION}")
    kinds = {c.split()[0]: c.split()[1] for c in COMMANDS.split(", ")}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
