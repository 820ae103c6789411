"""Pairwise-complete correlations of very many columns in one scan.

Every task adds up, for each pair of columns, the count, both means and the second moments around them over the rows where
both are known: products of masked matrices per batch, merged pairwise, so that a small spread around a large mean
survives. Partial sums of a column's pairs are one row; they are merged in two steps, so no task sees more than a share
of them.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from firmground.functions.columns import union_all
from firmground.functions.ordering import parallelism

# Task functions of this module travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, WIDE, SALTS = 2048, 1024, 16
PARTIAL = "i int, salt int, moments binary"


def batch_moments(x: np.ndarray) -> np.ndarray:
    """Four matrices of the columns of ``x`` (NaN: unknown): count, mean and spread of i where j is known, and co-spread;
    the mean of j is the transposed mean. Columns are centred on a value of their own, so constants stay exact."""
    known = ~np.isnan(x)
    some = known.any(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, x, 0).sum(axis=0) / known.sum(axis=0)
        off = np.where(known, np.abs(x - mean), np.inf)
        centre = np.where(some, x[off.argmin(axis=0), np.arange(x.shape[1])], 0.0)
        off = np.where(known, x - centre, 0.0)
        mask = known.astype(float)
        n = mask.T @ mask
        s, q, p = off.T @ mask, (off * off).T @ mask, off.T @ off
        d = np.where(n > 0, s / np.maximum(n, 1), 0.0)
    return np.stack([n, np.where(n > 0, centre[:, None] + d, 0.0), np.where(n > 0, np.maximum(q - s * d, 0.0), 0.0), np.where(n > 0, p - s * d.T, 0.0)])


def merged(a: np.ndarray, b: np.ndarray, mean_j: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Moments of both parts together; the means of j are the transposed ones unless given."""
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
    both = a[0] * share
    di = np.where(both > 0, b[1] - a[1], 0.0)
    dj = di.T if mean_j is None else np.where(both > 0, mean_j[1] - mean_j[0], 0.0)
    mean = np.where(a[0] == 0, b[1], np.where(b[0] == 0, a[1], a[1] + di * share))
    return np.stack([n, mean, a[2] + b[2] + di * di * both, a[3] + b[3] + di * dj * both])


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            part = batch_moments(x)
            total = part if total is None else merged(total, part)
    if total is not None:
        n, mean, q, p = total
        d = len(n)
        for i in range(d - 1):  # the pairs of i with later columns: both means, both spreads
            row = np.stack([n[i, i + 1:], mean[i, i + 1:], mean[i + 1:, i], q[i, i + 1:], q[i + 1:, i], p[i, i + 1:]])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()),
                                              pa.array([row.tobytes()], pa.binary())], names=["i", "salt", "moments"])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two rows of :func:`_sum_task` as one."""
    i = merged(a[[0, 1, 3, 5]], b[[0, 1, 3, 5]], (a[2], b[2]))
    j = merged(a[[0, 2, 4, 5]], b[[0, 2, 4, 5]], (a[1], b[1]))
    return np.stack([i[0], i[1], j[1], i[2], j[2], i[3]])


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key come one after another."""
    key, held = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held.tobytes()], pa.binary())],
                                          names=["i", "salt", "moments"])

    for batch in batches:
        for i, salt, blob in zip(*(batch.column(c).to_pylist() for c in ("i", "salt", "moments"))):
            part = np.frombuffer(blob).reshape(6, -1)
            if key == (i, salt):
                held = _joined(held, part)
            else:
                if key is not None:
                    yield row()
                key, held = (i, salt), part
    if key is not None:
        yield row()


def _correlation_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _merge_task(batches):
        i = batch.column("i")[0].as_py()
        n, _, _, qi, qj, p = np.frombuffer(batch.column("moments")[0].as_py()).reshape(6, -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = p / np.sqrt(qi * qj)
        flat = ~((n > 0) & (qi > 0) & (qj > 0))
        m = len(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i, np.int32)), pa.array(np.arange(i + 1, i + 1 + m, dtype=np.int32)),
                                          pa.array(r, pa.float64(), mask=flat)], names=["i", "j", "r"])


def correlations(wide: DataFrame, names: list[str]) -> DataFrame:
    """``col_a, col_b, r`` of every pair of the columns of ``wide`` (doubles, in the order of ``names``); null without spread.

    Up to ``WIDE`` columns are one scan; beyond it, one scan for each pair of halves of that many.
    """
    parts, half = parallelism(wide.sparkSession), WIDE // 2
    blocks = [list(range(at, min(at + half, len(names)))) for at in range(0, len(names), half)]
    if len(blocks) < 3:
        tiles = [(sum(blocks, []), lambda i, j: F.lit(True))]
    else:  # two blocks at a time; the pairs within a block come with the block after it, or before it for the last one
        tiles = []
        for i, a in enumerate(blocks):
            for k in range(i + 1, len(blocks)):
                own = {i} if k == i + 1 else set()
                own |= {k} if (i, k) == (len(blocks) - 2, len(blocks) - 1) else set()
                tiles.append((a + blocks[k], lambda x, y, own=own: (x != y) | x.isin(own or {-1})))
    out = []
    for tile, wanted in tiles:
        part = wide.select(*[F.col(wide.columns[c]).cast("double") for c in tile])
        summed = part.mapInArrow(_sum_task, PARTIAL).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        once = summed.repartition(parts, "i", "salt").sortWithinPartitions("i", "salt").mapInArrow(_merge_task, PARTIAL).withColumn("salt", F.lit(0))
        found = once.repartition(parts, "i").sortWithinPartitions("i").mapInArrow(_correlation_task, "i int, j int, r double")
        name = F.array(*[F.lit(names[c]) for c in tile])
        group = F.array(*[F.lit(c // half) for c in tile])
        found = found.where(wanted(group[F.col("i")], group[F.col("j")]))
        out.append(found.select(name[F.col("i")].alias("col_a"), name[F.col("j")].alias("col_b"), "r"))
    return union_all(out)
