"""The segmenter over tables of chunks, in batch and as a stream, and idempotent streaming merges.

Chunks carry (session_id, seq, ts, data). A session is a sequence, so sessions
are the unit of parallelism; a session's chunks pass through its machine one by
one. In a stream chunks may arrive late or out of order: they wait until the
sequence is contiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .segmenter import Command, Segmenter

SEGMENTS = (
    "session_id long, n long, cmd string, cwd string, exit_code int, started_ms long, ended_ms long, output binary, plain string, output_bytes long, truncated boolean"
)


def _rows(session_id: int, first: int, commands: list[Command]) -> pd.DataFrame:
    rows = [
        (session_id, first + k, c.cmd, c.cwd, c.exit_code, c.started_ms, c.ended_ms, c.output, c.plain, len(c.output), c.truncated)
        for k, c in enumerate(commands)
    ]
    found = pd.DataFrame(rows, columns=[x.split()[0] for x in SEGMENTS.split(", ")])
    return found.astype({"exit_code": "Int32"})


def _ms(ts) -> int:
    return 0 if pd.isna(ts) else int(pd.Timestamp(ts).value // 1_000_000)


_ARROW = pa.schema([
    ("session_id", pa.int64()), ("n", pa.int64()), ("cmd", pa.string()), ("cwd", pa.string()), ("exit_code", pa.int32()), ("started_ms", pa.int64()),
    ("ended_ms", pa.int64()), ("output", pa.binary()), ("plain", pa.string()), ("output_bytes", pa.int64()), ("truncated", pa.bool_()),
])
#: Bytes of output from which on a batch of commands is handed over.
BATCH_BYTES = 8 << 20


def segment_batch(chunks: DataFrame, **options) -> DataFrame:
    """The commands of every session. Rows reach a session's machine in order, a batch at a time, not all at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, machine, n, last = None, None, 0, 0
        columns: list[list] = [[] for _ in _ARROW]
        size = 0

        def add(commands: list[Command]) -> None:
            nonlocal n, size
            for c in commands:
                row = session, n, c.cmd, c.cwd, c.exit_code, c.started_ms, c.ended_ms, c.output, c.plain, len(c.output), c.truncated
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                n += 1
                size += len(c.output)

        def taken() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            for c in columns:
                c.clear()
            size = 0
            return out

        for batch in batches:
            for session_id, ms, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if machine is None or session_id != session:
                    if machine is not None:
                        add(machine.finish(last))
                    session, machine, n = session_id, Segmenter(**options), 0
                last = ms or 0
                add(machine.feed(data.as_py() or b"", last))
                if size >= BATCH_BYTES:
                    yield taken()
        if machine is not None:
            add(machine.finish(last))
        if columns[0]:
            yield taken()

    own = chunks.select("session_id", "seq", F.unix_millis("ts").alias("ms"), "data").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return own.select("session_id", "ms", "data").mapInArrow(run, SEGMENTS)


class _Sessions(StatefulProcessor):
    """A session's machine, its place in the sequence, and chunks that came too early.

    If there are timers, one runs at a time. Without a gap it is set anew by every chunk, and its
    end is the session's: what is open comes out. Behind a gap it keeps running, and
    its end gives the missing chunks up, so chunks wait no longer than that.
    """

    def __init__(self, options: dict, quiet_ms: int | None):
        self.options, self.quiet_ms = options, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "value binary")
        self.early = handle.getMapState("early", "seq long", "ts_ms long, data binary")

    def _state(self) -> tuple[Segmenter, int, int, int, bool]:
        return pickle.loads(self.machine.get()[0]) if self.machine.exists() else (Segmenter(**self.options), 0, 0, 0, False)

    def _wait(self, timer_values) -> None:
        if self.quiet_ms is None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, expected, n, last, gap = self._state()
        held: dict[int, tuple[int, bytes]] = {}
        for batch in rows:
            for seq, ts, data in zip(batch["seq"], batch["ts"], batch["data"], strict=True):
                if seq >= expected:  # a chunk sent twice counts once
                    held[int(seq)] = _ms(ts), bytes(data)
        found = []
        while expected in held or self.early.containsKey((expected,)):
            if expected in held:
                last, data = held.pop(expected)
            else:
                last, data = self.early.getValue((expected,))
            if self.early.containsKey((expected,)):
                self.early.removeKey((expected,))
            found += machine.feed(bytes(data), last)
            expected += 1
        for seq, value in held.items():
            self.early.updateValue((seq,), value)
        was, gap = gap, any(True for _ in self.early.keys())
        if not (was and gap):
            self._wait(timerValues)
        self.machine.update((pickle.dumps((machine, expected, n + len(found), last, gap)),))
        if found:
            yield _rows(int(key[0]), n, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, expected, n, last, gap = self._state()
        found = []
        if gap:
            for seq in sorted(k[0] for k in self.early.keys()):
                last, data = self.early.getValue((seq,))
                found += machine.feed(bytes(data), last)
                expected = seq + 1
                self.early.removeKey((seq,))
            self._wait(timerValues)
        else:
            found = machine.finish(last)
        self.machine.update((pickle.dumps((machine, expected, n + len(found), last, False)),))
        if found:
            yield _rows(int(key[0]), n, found)

    def close(self) -> None:
        pass


def segment_stream(chunks: DataFrame, quiet_ms: int | None = None, **options) -> DataFrame:
    """The commands finished so far, of a stream of chunks whose seq counts from 0 in each session.

    After ``quiet_ms`` of processing time without a chunk a session has ended, and its
    last command comes out with an unknown exit; a gap in the sequence is waited for as long.
    A stream with such timers asks for batches for ever, so it needs a trigger by time.
    Without ``quiet_ms`` nothing open comes out, gaps are waited for without end, and any trigger will do.
    """
    mode = "None" if quiet_ms is None else "ProcessingTime"
    grouped = chunks.select("session_id", "seq", "ts", "data").groupBy("session_id")
    return grouped.transformWithStateInPandas(_Sessions(options, quiet_ms), outputStructType=SEGMENTS, outputMode="Append", timeMode=mode)


#: Machines of a batch up to which each one's range of numbers is a filter of its own.
MACHINE_FILTERS = 200


def known_rows(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The table's rows that can share a key with the batch, by filters that prune files and row groups."""
    seq = batch.filter("machine is not null").groupBy("machine").agg(F.min("origin_seq").alias("low"), F.max("origin_seq").alias("high"))
    ranges = seq.orderBy("machine").limit(MACHINE_FILTERS + 1).collect()
    if len(ranges) > MACHINE_FILTERS:
        low, high = seq.agg(F.min("low"), F.max("high")).first()
        return existing.filter(F.col("origin_seq").between(low, high))
    near = F.lit(False)
    for r in ranges:
        near = near | ((F.col("machine") == r["machine"]) & F.col("origin_seq").between(r["low"], r["high"]))
    return existing.filter(near)


def merge_stream(batches: DataFrame, existing: str, checkpoint: str):
    """Rows of a stream appended to a table unless their (machine, origin_seq) is there: at-least-once in, once out.

    A batch reads only the part of the table within its machines' ranges of numbers.
    """
    from ..operators.merge import insert_or_ignore

    def add(batch: DataFrame, _: int) -> None:
        known = known_rows(batch.sparkSession.read.parquet(existing), batch)
        new = insert_or_ignore(known, batch.withColumn("file_pos", F.monotonically_increasing_id()))
        new.write.mode("append").parquet(existing)

    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
