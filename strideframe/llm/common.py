"""Helpers shared by the training-data operators: tables in the shared folder and Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strideframe.storage import shared_dir, work_path, written

__all__ = ["give_back", "released", "shared_dir", "small_batches", "split_batch", "stage", "with_fields", "work_path"]


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, and runs ``df`` once."""
    return written(df, name)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more fields at its end."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


#: Rows of an Arrow batch: at a few kB of text each, some MB.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: makes Arrow batches smaller than Spark's default, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def split_batch(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes at most (one row at least), so that a batch of long texts isn't held as Python objects at once."""
    rows = max(1, min(batch.num_rows, most * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Returns free memory to the system, that of Arrow's pool and, where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``, at whose end the worker gives free memory back: workers are used again, and what one task has freed would stay beside the next one's."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
