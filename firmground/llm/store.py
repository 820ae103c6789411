"""Intermediate tables in the folder all executors share, and small Arrow helpers for task code."""
from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from firmground.session import checkpoint_dir


#: Whether a query's shuffle files go when it has ended, instead of with the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A fresh folder below ``spark.checkpoint.dir`` for the tables one operator call writes.

    The tables cut lineage and survive lost executors. They back the DataFrame the operator returns, so they are
    removed when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def keep(self, df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
        """Write a table and read it back; with ``tidy`` the shuffle files of the write are removed when it is done."""
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        if tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if tidy:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _remove(self) -> None:
        try:
            self._delete(self.path)
        except (Py4JError, PySparkException, AttributeError, OSError):
            pass  # the session is gone already


def unused(names: list[str], taken: list[str]) -> list[str]:
    """The names, with underscores put in front until none is a column of ``taken`` (as Spark compares names)."""
    taken = {c.lower() for c in taken}
    while any(n.lower() in taken for n in names):
        names = [f"_{n}" for n in names]
    return names


def per_worker(key: tuple, build):
    """What ``build`` makes, kept by the Python worker from one task to the next until it is asked for two other things or
    :func:`release` is called. Only for things that change no result."""
    kept = sys.__dict__.setdefault("_firmground_kept", {})
    if key not in kept:
        while len(kept) > 1:
            kept.pop(next(iter(kept)))
        kept[key] = build()
    return kept[key]


def release() -> None:
    """Give back what earlier tasks of other kinds have left in this Python worker."""
    sys.__dict__.setdefault("_firmground_kept", {}).clear()
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null as empty) and the offset of each row, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes of text (one row at least), so that scratch arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, base = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, base + size, side="right")))
            yield batch.slice(at, end - at)
            at, base = end, int(sizes[end - 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, … of every row, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
