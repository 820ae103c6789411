"""Connected components of a table of links, by alternating star contraction in shared tables."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmground.llm.store import Workspace

_STAR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars around the smallest member of each of its own components."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [p for p in pairs if p[0] != p[1]]
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], schema=_STAR)


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """``(id, component)`` for every id of ``links(a, b)`` that is not the smallest of its component.

    Each task first contracts its own links; then every node passes its larger neighbours, and after that its smaller
    ones, to the smallest neighbour it knows, until nothing changes. Only minima are aggregated, so a node with very many
    links is combined before the shuffle, and no task sees a whole component.
    """
    edges = work.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").mapInArrow(
        _contract, "u long, v long").distinct(), f"{name}-0")
    mark, turn = _mark(edges), 0
    while mark[0]:
        turn += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        passed = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = work.keep(passed.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{turn}")
        now = _mark(after)
        edges = after
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
