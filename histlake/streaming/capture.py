"""The bounded output buffer: the first and last bytes of an output, with a note of what lies between."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_CAP, TAIL_CAP = 256 * 1024, 1024 * 1024


def gap_note(n: int) -> bytes:
    return f"\n… [{n} bytes truncated] …\n".encode()


@dataclass
class HeadTail:
    """At most ``head_cap`` + ``tail_cap`` bytes of all that was written.

    The tail is a list of what came in, joined and cut once it holds twice its
    cap, so a byte is copied a constant number of times however small the writes.
    """

    head_cap: int = HEAD_CAP
    tail_cap: int = TAIL_CAP
    head: bytearray = field(default_factory=bytearray)
    parts: list[bytes] = field(default_factory=list)
    held: int = 0
    total: int = 0

    def write(self, data: bytes) -> None:
        self.total += len(data)
        room = self.head_cap - len(self.head)
        if room > 0:
            self.head += data[:room]
            data = data[room:]
        if data:
            self.parts.append(data)
            self.held += len(data)
            if self.held > 2 * self.tail_cap:
                self._cut()

    def _cut(self) -> None:
        tail = b"".join(self.parts)
        tail = tail[max(0, len(tail) - self.tail_cap) :]
        self.parts, self.held = [tail], len(tail)

    def truncated(self) -> bool:
        return self.total > len(self.head) + min(self.held, self.tail_cap)

    def value(self) -> bytes:
        self._cut()
        gap = self.total - len(self.head) - self.held
        return bytes(self.head) + (gap_note(gap) if gap else b"") + self.parts[0]


def clip_bytes(data: Column, head: int = HEAD_CAP, tail: int = TAIL_CAP) -> Column:
    """The same of one binary value, in the JVM."""
    n = F.octet_length(data)
    note = F.encode(F.format_string("\n… [%d bytes truncated] …\n", n - (head + tail)), "UTF-8")
    return F.when(n <= head + tail, data).otherwise(F.concat(F.substring(data, 1, head), note, F.substring(data, -tail, tail)))


def capture(chunks: DataFrame, key: str, order: str = "seq", data: str = "data", head: int = HEAD_CAP, tail: int = TAIL_CAP) -> DataFrame:
    """(key, output, output_bytes, truncated): ordered chunks of each key put through the buffer."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        buffer = HeadTail(head, tail)
        for x in rows.sort_values(order)[data]:
            buffer.write(bytes(x))
        out = buffer.value()
        return pd.DataFrame({key: [rows[key].iloc[0]], "output": [out], "output_bytes": [len(out)], "truncated": [buffer.truncated()]})

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.groupBy(key).applyInPandas(run, f"{key} {kind}, output binary, output_bytes long, truncated boolean")
