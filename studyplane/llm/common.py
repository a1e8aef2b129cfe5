"""What the operators share: the shared work folder, written intermediate tables, ragged byte arrays."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch sent to Python. Whole texts travel in these batches, so they stay small.
BATCH_ROWS = 1000


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a temporary folder is set for sessions in local mode; on a cluster no folder of one machine would do, so that is
    an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="studyplane-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/studyplane-{uuid.uuid4().hex}"


#: Temporary folders of sessions in local mode, by application; each goes when the driver ends.
_LOCAL: dict[str, str] = {}


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: later steps start from it when executors are lost."""
    path = f"{work_dir(df.sparkSession)}/{name}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as a row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def distinct_names(keep: tuple[str, ...], made: tuple[str, ...]) -> None:
    """An error where columns to keep would stand twice in a result."""
    if set(made) & set(keep) or len(set(keep)) < len(keep):
        raise ValueError(f"keep names a column of the result, or one twice: {keep}")


#: Caches that stay in a Python worker between tasks.
_CACHES: list = []


def lasting(cache):
    """Marks an lru_cache as one that tasks of its own operator leave in the worker."""
    _CACHES.append(cache)
    return cache


def tidy(keep=None) -> None:
    """Gives back what earlier tasks left in this Python worker, all but the cache `keep`.

    Spark uses workers again for the next operator, whose arrays then stand beside freed memory that the allocators hold on to."""
    for cache in _CACHES:
        if cache is not keep:
            cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def over_batches(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows for mapInArrow, with a tidy worker before and after."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        yield from rows(batches)
        tidy(keep)

    return task


def over_group(made: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """made for applyInArrow, with a tidy worker after each group."""

    def task(t: pa.Table) -> pa.Table:
        out = made(t)
        tidy()
        return out

    return task


def ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and where each row begins (one more than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose bytes stay under `most`, one row at least."""
    out, begin = [], 0
    n = len(offsets) - 1
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(n, max(begin + 1, end))
        out.append((begin, end))
        begin = end
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
