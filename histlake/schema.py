"""Explicit schemas of the store's tables, and the meaning of their sentinels.

``started_ms`` 0 is an unknown time, a null ``exit_code`` an unknown exit,
``session_id`` 0 an imported row, a null ``machine`` a local one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMANDS = (
    "id LONG, session_id LONG, cmd STRING, cwd STRING, exit_code INT, started_ms LONG, ended_ms LONG, output BINARY, plain STRING, "
    "plain_lc STRING, output_bytes LONG, truncated BOOLEAN, machine STRING, host STRING, origin_seq LONG, note STRING"
)
SESSIONS = "id LONG, started_ms LONG, hostname STRING, shell STRING, term STRING"
IMPORT_STATE = "machine STRING, host STRING, last_seq LONG, updated_ms LONG"
SYNC_STATE = "k STRING, v LONG"
CHUNKS = "session_id LONG, seq LONG, ts TIMESTAMP, data BINARY"
ENTRIES = "source STRING, file_pos LONG, seq LONG, cmd STRING, cwd STRING, host STRING, exit_code INT, started_ms LONG, ended_ms LONG"

#: Schema version, kept in table properties; versions only add columns.
VERSION = 1
DAY_MS = 86_400_000


def known_start(c: str = "started_ms") -> Column:
    """The start, or null if it is unknown."""
    return F.when(F.col(c) > 0, F.col(c))


def duration_ms() -> Column:
    """ended - started where both are known, else null; may be negative."""
    return F.when((F.col("started_ms") > 0) & F.col("ended_ms").isNotNull(), F.col("ended_ms") - F.col("started_ms"))


def failed() -> Column:
    return F.col("exit_code").isNotNull() & (F.col("exit_code") != 0)


def started_day(zone: str | None = None) -> Column:
    """The day as yyyy-MM-dd, ``unknown`` without a time; UTC, or the given zone."""
    if zone is None:
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("started_ms") / DAY_MS).cast("int")).cast("string")
    else:
        day = F.date_format(F.from_utc_timestamp(F.timestamp_millis("started_ms"), zone), "yyyy-MM-dd")
    return F.when(F.col("started_ms") > 0, day).otherwise("unknown")


def with_search_text(commands):
    """Adds ``plain_lc``, the lower-cased copy whose ``contains`` filters reach the Parquet scan."""
    return commands.withColumn("plain_lc", F.lower("plain"))
