"""Session helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of whole texts, and of numbers. Batches of many long texts fill memory beside the heap in the JVM and in Python.
TEXT_ROWS, NARROW_ROWS = 1000, 10_000

#: Bytes of an Arrow batch; a thousand long texts would be far more.
BATCH_BYTES = "4m"

_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to TEXT_ROWS and BATCH_BYTES where they are larger."""
    spark.conf.set(_BYTES, BATCH_BYTES)
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='pricewell-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    batch_rows: rows of an Arrow batch meanwhile, TEXT_ROWS if none are given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH), spark.conf.get(_BYTES)
    try:
        spark.conf.set(_BATCH, str(batch_rows or TEXT_ROWS))
        spark.conf.set(_BYTES, BATCH_BYTES)
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before[0])
        spark.conf.set(_BYTES, before[1])
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counts: DataFrame, most: int, kinds: int) -> DataFrame:
    """The rows of the greatest counts n, whole steps of counts (2 % apart) as long as they are ``most`` rows or fewer; kinds: rows there are.

    Only the steps' sizes are gathered, so no task sorts all counts.
    """
    if kinds <= most:
        return counts
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1.02))).cast("int")
    least, room = 1 << 30, most
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # about 2,000 steps at most
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return counts.where(step >= least)


def trimmed(task):
    """The task for mapInArrow, handing freed memory back to the machine at its end: idle Python workers stay alive beside those of later steps."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), pa.array(values))


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[bounds[i]:bounds[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = np.asarray(bounds, np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(values)]).cast(pa.binary())
