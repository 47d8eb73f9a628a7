"""Substring search over commands, outputs and notes, with grep-style context."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.highlight import highlight, snippet
from ..plans.filters import Filter
from .listing import newest

#: Shorter queries match nothing in commands and outputs.
LEAST_QUERY = 3
MOST_HUNKS = 5


def _fold_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def text_hit(query: str) -> Column:
    """The query is in the command or its output, case aside; on ``plain_lc`` the filter reaches the scan."""
    if len(query) < LEAST_QUERY:
        return F.lit(False)
    q = query.lower()
    return F.coalesce(F.col("plain_lc").contains(q) | F.lower("cmd").contains(q), F.lit(False))


def note_hit(query: str) -> Column:
    """The query is in the note, ASCII case aside; % and _ are plain characters."""
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    return F.coalesce(_fold_ascii(F.col("note")).contains(fold), F.lit(False))


def search(commands: DataFrame, query: str, where: Filter = Filter()) -> DataFrame:
    """The newest rows that hold the query in text or note, one scan for both; snippets only for the rows returned."""
    hit = commands.filter(text_hit(query) | note_hit(query))
    rows = where.apply(hit).orderBy(*newest()).limit(where.rows())
    by_text = text_hit(query)
    marked = F.when(by_text, snippet(F.col("plain"), F.lit(query))).otherwise(F.concat(F.lit("note: "), highlight(F.col("note"), F.lit(query))))
    return rows.withColumn("snippet", marked)


def search_ids(commands: DataFrame, query: str, where: Filter = Filter()) -> DataFrame:
    """``search`` without snippets: no Python in the plan."""
    hit = commands.filter(text_hit(query) | note_hit(query))
    return where.apply(hit).orderBy(*newest()).limit(where.rows()).select("id", "started_ms", "cmd")


def notes(commands: DataFrame, query: str, where: Filter = Filter()) -> DataFrame:
    rows = where.apply(commands.filter(note_hit(query))).orderBy(*newest()).limit(where.rows())
    return rows.select("id", "started_ms", "note")


def lines_of(rows: DataFrame, text: str = "plain") -> DataFrame:
    """(id, i, line): the text's lines; one empty line at the end is dropped."""
    trimmed = F.regexp_replace(F.col(text), r"\n\z", "")
    return rows.select("id", F.posexplode(F.split(trimmed, "\n", -1)).alias("i", "line"))


def grep_lines(rows: DataFrame, query: str, before: int, after: int, text: str = "plain") -> DataFrame:
    """(id, hunk, i, line, is_match): matching lines with context, hunks joined where they touch."""
    each = lines_of(rows, text).withColumn("is_match", F.lower("line").contains(query.lower()))
    around = Window.partitionBy("id").orderBy("i").rowsBetween(-after, before)
    kept = each.withColumn("keep", F.max("is_match").over(around)).filter("keep")
    order = Window.partitionBy("id").orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(order) == 1, 0).otherwise(1)
    return kept.withColumn("new", new).withColumn("hunk", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("id", "hunk", "i", "line", "is_match")


def grep_hunks(rows: DataFrame, query: str, before: int, after: int, text: str = "plain") -> DataFrame:
    """One row per hunk, up to MOST_HUNKS a text: id, hunk, start, lines, is_match."""
    own = grep_lines(rows, query, before, after, text).filter(F.col("hunk") <= MOST_HUNKS)
    grouped = own.groupBy("id", "hunk").agg(F.array_sort(F.collect_list(F.struct("i", "line", "is_match"))).alias("l"))
    return grouped.select("id", "hunk", F.col("l")[0]["i"].alias("start"), F.col("l.line").alias("lines"), F.col("l.is_match").alias("is_match"))


def grep_totals(rows: DataFrame, query: str, before: int, after: int, text: str = "plain") -> DataFrame:
    """Matching lines in all, and within the hunks returned."""
    own = grep_lines(rows, query, before, after, text)
    hit = F.col("is_match").cast("int")
    return own.groupBy("id").agg(F.sum(hit).alias("total"), F.sum(F.when(F.col("hunk") <= MOST_HUNKS, hit).otherwise(0)).alias("shown"))


#: A match at each character that two more follow; the group holds the three. A ``.`` is a whole code point.
TRIGRAM = "(?s)(?=(.{3}))."


def trigrams(rows: DataFrame, key: str = "id", text: Column | None = None) -> DataFrame:
    """(key, tri): the posting table of the search accelerator, written bucketed by trigram. The text is that of commands unless given."""
    if text is None:
        text = F.concat_ws("\n", F.lower("cmd"), "plain_lc")
    return rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TRIGRAM)))).alias("tri"))


#: Partitions of a written posting table.
POSTING_BUCKETS = 64


def postings(rows: DataFrame) -> DataFrame:
    """``trigrams`` dealt to buckets and sorted by trigram, to be written partitioned by ``bucket``."""
    dealt = trigrams(rows).withColumn("bucket", (F.crc32(F.encode("tri", "UTF-8")) % POSTING_BUCKETS).cast("int"))
    # A trigram, and so a bucket, may hold any share of the rows: large ones are split.
    return dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "tri", "id")


def _candidates(postings: DataFrame, query: str, key: str = "id") -> DataFrame:
    """Keys that hold all trigrams of the query. Of a written table only the trigrams' buckets are read."""
    q = query.lower()
    wanted = sorted({q[k : k + 3] for k in range(len(q) - 2)})
    own = postings.filter(F.col("tri").isin(wanted))
    if "bucket" in postings.columns:
        own = own.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % POSTING_BUCKETS for t in wanted})))
    return own.groupBy(key).agg(F.count_distinct("tri").alias("n")).filter(F.col("n") == len(wanted)).select(key)


def search_by_trigrams(commands: DataFrame, postings: DataFrame, query: str, where: Filter = Filter()) -> DataFrame:
    """Candidates that hold all trigrams of the query, then the exact test."""
    hit = commands.join(_candidates(postings, query), "id", "left_semi").filter(text_hit(query))
    return where.apply(hit).orderBy(*newest()).limit(where.rows()).select("id", "started_ms", "cmd")


def search_shared(commands: DataFrame, texts: DataFrame, postings: DataFrame, query: str, where: Filter = Filter()) -> DataFrame:
    """``search_by_trigrams`` where a text stands once for all commands that printed it.

    ``commands`` names it by ``text_id`` (null: none); ``texts`` is (text_id, plain_lc), and ``postings`` its trigrams.
    Command lines come with the rows and are short: they are tested as they are.
    """
    found = texts.join(_candidates(postings, query, "text_id"), "text_id", "left_semi").filter(F.col("plain_lc").contains(query.lower()))
    by_line = F.coalesce(F.lower("cmd").contains(query.lower()), F.lit(False)) if len(query) >= LEAST_QUERY else F.lit(False)
    rows = where.apply(commands)
    hit = rows.filter(by_line).unionByName(rows.filter(~by_line).join(found.select("text_id"), "text_id", "left_semi").select(*rows.columns))
    return hit.orderBy(*newest()).limit(where.rows()).select("id", "started_ms", "cmd")
