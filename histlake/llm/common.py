"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..session import ship

#: Rows and bytes of an Arrow batch; whole texts are carried, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none a temporary folder is set once, as the
    checkpoint folder as well; this needs a local master, as in tests, since a
    machine's own folder is not shared on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='histlake-')}"
        spark.sparkContext.setCheckpointDir(folder)
    # A path without a scheme is the cluster's default file system's, not a machine's own.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full).rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on.

    Short Arrow batches; and Bloom filters of at most 8 MB ahead of a shuffled
    join of texts with the few that are needed, at any size of the tables.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1TB")


def _own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/histlake"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, this application's own."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    whatever reads the table twice sees the same rows.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    # The write's shuffle files go once the driver has collected its garbage.
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all staged tables and archives of this application, no other's; results read from them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with state made once per task: ``make()`` returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out
        del step
        release()

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the table does not have yet, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _holds(kind: DataType, wanted: type) -> bool:
    """Whether a type is the wanted one or has it inside."""
    inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []
    return isinstance(kind, wanted) or any(_holds(k, wanted) for k in inner)


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's values; maps, which Spark does not hash, count by their JSON."""
    own = [(F.col(f"`{f.name}`"), _holds(f.dataType, MapType)) for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c.alias("v"))) if mapped else c for c, mapped in own])


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    """A record batch of these columns, in this order."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def release() -> None:
    """Give a worker's freed memory back: it stays alive, idle, beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """The fixed evaluation fold: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
