"""Media columns: payloads stored in archives, read back by a custom data source.

A text's bytes, padded to rows of ROW samples, become an 8-bit grey image (PNG,
lossless). Images are members of ZIP archives in a folder all executors share.
The source ``histlake_archive`` plans byte ranges of the archives; the reader
of a range takes the members that begin in it from the archive's directory,
streams them as Arrow batches, and reads a member anew, at its offset, when a
read fails or its checksum is wrong.

An archive's name follows from the task's place in the plan and a count, and it
is moved into place when complete: a task run again writes the same archive
over it. Members carry no time, so equal payloads have equal stored bytes.

Cases: null and empty texts are one row of padding; repeated rows and null ids
are members of their own; an empty table makes no archive and gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import map_rows, prepare, scratch, text_bytes

ROW = 576
PAD = b"\xff"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
TRIES = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LENGTH = b"Bytes\0"


def pad(data: bytes) -> bytes:
    """The bytes, followed by PAD up to a positive multiple of ROW."""
    return data + PAD * (-len(data) % ROW if data else ROW)


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image of ROW samples a line; the unpadded length is a text chunk."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.zeros((len(payload) // ROW, ROW + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    header = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    data = zlib.compress(lines.tobytes(), 1)
    parts = [data[k : k + (1 << 30)] for k in range(0, len(data), 1 << 30)]
    return b"".join([_SIGNATURE, chunk(b"IHDR", header), chunk(b"tEXt", _LENGTH + str(n_bytes).encode()), *(chunk(b"IDAT", p) for p in parts), chunk(b"IEND", b"")])


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of a stored image; raises ValueError if it is damaged."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, data, n_bytes, lines = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            lines = struct.unpack_from(">II", body)[1]
        elif kind == b"tEXt":
            n_bytes = int(body[len(_LENGTH) :])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    samples = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(lines, ROW + 1)
    return samples[:, 1:].tobytes(), n_bytes


def features(payload: bytes) -> str:
    """Lines, mean, deviation, range and quarter histogram of the samples, in integers."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    n, total, squares = len(x), int(counts @ values), int(counts @ values**2)
    held = np.flatnonzero(counts)
    quarter = ":".join(map(str, counts.reshape(4, 64).sum(axis=1).tolist()))
    return f"lines={n // ROW};mean_milli={1000 * total // n};var={(squares - total * total // n) // n};min={held[0]};max={held[-1]};quarters={quarter}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def write_archives(docs: DataFrame, folder: str) -> int:
    """Store every document's image below ``folder``; the number of members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        place, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        count, made, members, out, archive = 0, 0, 0, None, None

        def close() -> None:
            nonlocal archive, made
            if archive is not None:
                archive.close()
                out.close()
                fs.move(f"{base}/_open-{place}-{made}-{attempt}", f"{base}/part-{place:06d}-{made:04d}.zip")
                archive, made = None, made + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if archive is None:
                    out = fs.open_output_stream(f"{base}/_open-{place}-{made}-{attempt}")
                    archive, count = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                media = encode_png(pad(text), len(text))
                archive.writestr(zipfile.ZipInfo(f"{members:09d}/{'' if doc_id is None else doc_id}.png"), media)
                members += 1
                count += len(media)
                if count >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], names=["members"])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "members long").agg(F.sum("members")).first()[0] or 0


class Range(InputPartition):
    """The members of one archive that begin in a byte range."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


MEMBERS = "archive string, offset long, name string, media binary"


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        fs, base = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        archives = sorted((f.path, f.size) for f in found if f.base_name.startswith("part-") and f.base_name.endswith(".zip"))
        return [Range(p, k, k + self.range_bytes) for p, size in archives for k in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open(self.folder)
        members, archive = None, None
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                names=["archive", "offset", "name", "media"],
            )

        def opened() -> zipfile.ZipFile:
            return zipfile.ZipFile(io.BufferedReader(fs.open_input_file(partition.path)))

        archive = retried(opened)
        members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        for m in members:
            def one(m: zipfile.ZipInfo = m) -> bytes:
                nonlocal archive
                try:
                    return archive.read(m)
                except Exception:
                    archive = opened()  # the next try starts from a new handle, at the member's offset
                    raise

            rows.append((partition.path, m.header_offset, m.filename, retried(one)))
            size += len(rows[-1][3])
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


def retried(action, tries: int = TRIES, wait: float = 0.2):
    """The action's result, after as many tries as it takes, up to a bound."""
    for k in range(tries):
        try:
            return action()
        except (OSError, zipfile.BadZipFile, zlib.error, EOFError):
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    return None


class ArchiveSource(DataSource):
    """``spark.read.format("histlake_archive").load(folder)``; option ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "histlake_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("histlake_archive").load(folder)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text, read it back, and describe it: one row per document."""
    folder = scratch(docs.sparkSession, "media")
    write_archives(docs, folder)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, n_bytes = decode_png(media)
                own = name.rpartition("/")[2].removesuffix(".png")
                rows.append((
                    int(own) if own else None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), features(payload),
                ))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(read_archives(docs.sparkSession, folder).select("name", "media"), make, schema)
