"""Line deduplication over range-partitioned line hashes.

Lines become 128-bit hashes with document and position. They are range-partitioned by (hash, document, position) and sorted
within partitions, so a line that a third of all documents share spans several partitions. Each task streams its rows and
knows the first document of every hash but that of a hash begun in an earlier partition; those come from a table of the
edges of all partitions. What leaves the sort are only the dropped places, gathered per document into a compressed bitmap.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from firmground.llm.store import Workspace, slices

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
KEYS = "h1 long, h2 long, doc_id long, body long, pos long"
SORTED = "part int, run int, h1 long, h2 long, doc_id long, body long, pos long, first_doc long"
_SORTED = pa.schema([("part", pa.int32()), ("run", pa.int32())] + [(c, pa.int64()) for c in ("h1", "h2", "doc_id", "body", "pos", "first_doc")])


def body_hash(text: bytes) -> int:
    """Tells apart rows that repeat an id with different texts."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def line_keys(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Position and key of every line long enough to count."""
    for pos, line in enumerate(text.split(b"\n")):
        if len(line) >= least:
            key = line.strip(SPACE).lower()
            if len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least:
                yield pos, key


def _key_task(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, docs, bodies, places = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = (text or "").encode("utf-8", "surrogatepass")
                body = body_hash(text)
                for pos, key in line_keys(text, least):
                    digests.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    bodies.append(body)
                    places.append(pos)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))] + [
                pa.array(x, pa.int64()) for x in (docs, bodies, places)], names=["h1", "h2", "doc_id", "body", "pos"])

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First document of each hash as far as this partition knows, for rows of later documents and of the first hash.

    ``run`` is 0 for rows of the partition's first hash, whose decision waits for the edges, 1 for rows dropped already, and
    2 for one row that reports the first document of the partition's last hash.
    """
    part, opening, held = TaskContext.get().partitionId(), None, None
    for batch in batches:
        h1, h2, doc, body, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(h1)
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if held is not None:
            new[0] = (h1[0], h2[0]) != held[:2]
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(start >= 0, doc[np.maximum(start, 0)], held[2] if held is not None else 0)
        if opening is None:
            opening = (h1[0], h2[0])
        run = np.where((h1 == opening[0]) & (h2 == opening[1]), 0, 1).astype(np.int32)
        keep = np.flatnonzero((run == 0) | (first != doc))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keep), part, np.int32)), pa.array(run[keep])] + [pa.array(x[keep]) for x in (h1, h2, doc, body, pos, first)],
            schema=_SORTED)
        held = (h1[-1], h2[-1], first[-1])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([2], pa.int32())] + [
            pa.array([int(x)], pa.int64()) for x in (held[0], held[1], 0, 0, 0, held[2])], schema=_SORTED)


def bitmap(dropped: list[int]) -> bytes:
    """Compressed bits of the dropped positions, the first position in the lowest bit."""
    bits = np.zeros(max(dropped) + 1, np.uint8)
    bits[dropped] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def dropped_of(packed: bytes | None) -> set[int]:
    """The positions a bitmap drops; none without a bitmap."""
    if not packed:
        return set()
    return set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")).tolist())


def _bitmap_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [bitmap(x) for x in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(packed, pa.binary())],
                                         names=["doc_id", "body", "dropped"])


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``doc_id, body, dropped`` for every document that loses lines; ``dropped`` is a compressed bitmap of line positions.

    A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased. Keys of at least ``least``
    code points that several documents hold stay only in the one of the smallest id, there each time. ``body`` is the hash
    of the whole text and tells rows that repeat an id apart; such rows count as one document, so they take no lines from
    each other. Rows with a null id neither lose lines nor take any. Null and empty texts have one empty line, too
    short to count. Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "line-dedup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    keys = work.keep(source.mapInArrow(_key_task(least), KEYS), "keys")
    order = ["h1", "h2", "doc_id", "pos", "body"]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("h1", "h2", "doc_id", "body", "pos")
    streamed = work.keep(ordered.mapInArrow(_stream, SORTED), "sorted")
    # The first document of a hash at the edge of partitions: at most two rows for each partition.
    opening = streamed.where("run = 0").groupBy("part", "h1", "h2").agg(F.min("first_doc").alias("first_doc"))
    closing = streamed.where("run = 2").select("part", "h1", "h2", "first_doc")
    edges = opening.union(closing).groupBy("h1", "h2").agg(F.min("first_doc").alias("least"))
    waiting = streamed.where("run = 0").join(F.broadcast(edges), ["h1", "h2"]).where("doc_id <> least")
    places = streamed.where("run = 1").select("doc_id", "body", "pos").union(waiting.select("doc_id", "body", "pos"))
    return places.groupBy("doc_id", "body").agg(F.collect_list("pos").alias("places")).mapInArrow(
        _bitmap_task, "doc_id long, body long, dropped binary")


def _apply_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines, gone, kept = [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column("dropped").to_pylist()):
            each, drop = (text or "").split("\n"), dropped_of(packed)
            lines.append(len(each))
            gone.append(len(drop))
            kept.append("\n".join(x for i, x in enumerate(each) if i not in drop) if drop else text or "")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept)],
                                         names=["doc_id", "n_lines", "n_dropped", "kept"])


def _body_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        body = [body_hash((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body, pa.int64())], names=["doc_id", "text", "body"])


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: every document with its remaining lines, joined by line feeds."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = source.mapInArrow(_body_task, "doc_id long, text string, body long")
    return marked.join(keep_bitmaps(docs, doc_id, text, least), ["doc_id", "body"], "left").select("doc_id", "text", "dropped").mapInArrow(
        _apply_task, "doc_id long, n_lines long, n_dropped long, kept string")
