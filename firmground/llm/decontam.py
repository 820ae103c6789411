"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over eight consecutive words: the masked-out places may differ. Seeds of all benchmark items are
compared with the seeds at every place of every document; a hit fixes an alignment of item and document, along which words
are compared around the hit, so that overlaps with substituted words are found and measured.

Benchmark items are the stated query set: their seeds travel to the tasks in blocks of at most ``block_words`` words, one
pass over the documents per block, so what is broadcast has a bound and no document row is shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmground.llm.store import Workspace, ragged, slices, text_bytes
from firmground.llm.words import PUNCTUATED, mix, words

#: Places of eight words that must agree. Any one substitution among eight words leaves at least one of them whole.
MASKS = ("11101011", "11011101", "10110111", "11110000", "00001111")
SPAN = 8
#: Words of an item in a row that make an overlap, however long the item is.
RUN = 13
_STEPS = mix(np.arange(1001, 1001 + SPAN, dtype=np.uint64)) | np.uint64(1)
HITS = "doc_id long, item_id long, item_words long, matched long, start long, length long"


def seeds(hashes: np.ndarray, bounds: np.ndarray, length: int, places: list[int], tag: int):
    """``(seed, row, place)`` of every run of ``length`` words that lies in one row."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    at = ragged(bounds[:-1], counts)
    total = np.full(len(at), tag, np.uint64)
    for p in places:
        total += hashes[at + p] * _STEPS[p]
    return mix(total), np.repeat(np.arange(len(counts)), counts), at


def forms(lengths: set[int]) -> list[tuple[int, list[int], int, int]]:
    """Masks as (words, places, tag, size of the items they serve or 0 for all). An item shorter than a mask has seeds of its own:
    from four words on, one word may differ or be missing at an end; below, all must agree."""
    out = [(SPAN, [i for i, c in enumerate(m) if c == "1"], 1000 + k, 0) for k, m in enumerate(MASKS)]
    for n in sorted(lengths):
        if 0 < n < 4:
            out.append((n, list(range(n)), n, n))
        elif n < SPAN and n:
            out.append((n - 1, list(range(n - 1)), 10 * n, n))
            out += [(n, [p for p in range(n) if p != i], 10 * n + i, n) for i in range(1, n - 1)]
    return out


def longest_run(at: np.ndarray, least: float) -> tuple[int, int]:
    """First and last index of the longest stretch of the sorted places ``at`` that holds ``least`` of the places it spans."""
    level = np.arange(len(at)) - least * at
    low = np.minimum.accumulate(level)
    first = np.searchsorted(-low, -(level + 1 - least + 1e-9))  # the earliest place low enough
    span = at - at[np.minimum(first, np.arange(len(at)))]
    last = int(np.argmax(span))
    return int(first[last]), last


class Block:
    """Benchmark items prepared for search: words, seeds in hash order, and where each seed stands."""

    def __init__(self, ids: np.ndarray, column: pa.Array):
        self.ids = ids
        data, offsets = text_bytes(column)
        self.hashes, self.bounds, _, _ = words(data, offsets, PUNCTUATED)
        sizes = np.diff(self.bounds)
        self.forms, self.tables = forms(set(sizes.tolist())), []
        for length, places, tag, only in self.forms:
            seed, row, at = seeds(self.hashes, self.bounds, length, places, tag)
            if only:  # items of exactly this size
                keep = sizes[row] == only
                seed, row, at = seed[keep], row[keep], at[keep]
            order = np.argsort(seed, kind="stable")
            self.tables.append((seed[order], row[order], at[order]))


def search(block: Block, ids: list, column: pa.Array, least: float, run: int = RUN) -> tuple[list[tuple], np.ndarray]:
    """``(doc_id, item_id, item_words, matched, start, length)`` of each document and item that overlap enough.

    Around every hit, up to two spans to each side, equal words on the alignment count; ``matched`` is the number of the
    item's words so covered, over all hits. ``start`` and ``length`` give the words of the document that take part. A pair
    below ``least`` counts too if on one alignment ``run`` words or more of the item stand in the document, ``least`` of them
    equal; its numbers are those of the longest such run. The second result holds the places of the documents concerned.
    """
    data, offsets = text_bytes(column)
    hashes, bounds, _, _ = words(data, offsets, PUNCTUATED)
    found = []
    for (length, places, tag, _), (table, row, at) in zip(block.forms, block.tables):
        if not len(table) or not len(hashes):
            continue
        seed, doc, place = seeds(hashes, bounds, length, places, tag)
        first = np.searchsorted(table, seed)
        hit = np.flatnonzero(table[np.minimum(first, len(table) - 1)] == seed)
        if not len(hit):
            continue
        first = first[hit]
        count = np.searchsorted(table, seed[hit], side="right") - first
        which = ragged(first, count)
        found.append(np.stack([np.repeat(doc[hit], count), row[which], np.repeat(place[hit], count), at[which]]))
    if not found:
        return [], np.zeros(0, np.int64)
    doc, item, place, at = np.concatenate(found, axis=1)
    same = np.unique(np.stack([doc, item, place, at]), axis=1)  # masks repeat an alignment
    doc, item, place, at = same
    step = np.arange(-2 * SPAN, 3 * SPAN)
    parts = []
    for i in range(0, len(doc), 20_000):
        d, m = doc[i:i + 20_000, None], item[i:i + 20_000, None]
        x, y = place[i:i + 20_000, None] + step, at[i:i + 20_000, None] + step
        inside = (x >= bounds[d]) & (x < bounds[d + 1]) & (y >= block.bounds[m]) & (y < block.bounds[m + 1])
        r, c = np.nonzero(inside & (hashes[np.where(inside, x, 0)] == block.hashes[np.where(inside, y, 0)]))
        parts.append(np.stack([doc[i + r], item[i + r], y[r, c], x[r, c]]))
    doc, item, at, place = np.concatenate(parts, axis=1)
    pair, which = np.unique(np.stack([doc, item]), axis=1, return_inverse=True)
    which = which.reshape(-1)
    matched = np.bincount(np.unique(np.stack([which, at]), axis=1)[0], minlength=pair.shape[1])
    lo, hi = np.full(pair.shape[1], len(hashes)), np.zeros(pair.shape[1], np.int64)
    np.minimum.at(lo, which, place)
    np.maximum.at(hi, which, place)
    size = np.diff(block.bounds)[pair[1]]
    first, length, enough = lo - bounds[pair[0]], hi - lo + 1, matched >= least * size
    some = ~enough[which]  # runs of the pairs that are not covered as a whole
    if some.any():
        rows = np.unique(np.stack([which[some], (place - at)[some], at[some]]), axis=1)
        cut = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
        ends = np.append(cut[1:], rows.shape[1])
        best = np.zeros(pair.shape[1], np.int64)
        for u, v in zip(cut[ends - cut >= least * run], ends[ends - cut >= least * run]):
            w, shift, places = rows[0, u], rows[1, u], rows[2, u:v]
            i, j = longest_run(places, least)
            span = places[j] - places[i] + 1
            if span >= run and span > best[w]:
                best[w], enough[w], matched[w] = span, True, j - i + 1
                first[w], length[w] = places[i] + shift - bounds[pair[0, w]], span
    return [(ids[pair[0, i]], int(block.ids[pair[1, i]]), int(size[i]), int(matched[i]), int(first[i]), int(length[i]))
            for i in np.flatnonzero(enough)], pair[0, enough]


def _search_task(shipped, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*shipped.value)
        for batch in slices(batches, "text"):
            rows, _ = search(block, batch.column("doc_id").to_pylist(), batch.column("text"), least)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 names=[x.split()[0] for x in HITS.split(", ")])

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             least: float = 0.75, block_words: int = 2_000_000) -> DataFrame:
    """One row per document and benchmark item of which it holds ``least`` of the words or more, or a run of ``RUN`` words or
    more on one alignment with ``least`` of them equal (then ``matched, start, length`` are those of the run).

    A run is found if eight of its words in a row agree but for one, or four in a row with four more beside them.

    Columns: ``doc_id, item_id, item_words, matched, start, length`` (words of the document). Words are runs of letters,
    digits and non-ASCII characters; A-Z count as a-z, so changed punctuation hides nothing. Null and empty texts and items
    match nothing. Rows with a null item id are ignored; documents with a null id are searched and reported with a null id.
    Repeated items or documents give one row for each distinct result. Other columns are ignored; an empty table gives an
    empty result.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for shipped in _blocks(benchmark, item_id, text, block_words):
        hits = source.mapInArrow(_search_task(shipped, least), HITS)
        found = hits if found is None else found.union(hits)
    return found.distinct()


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> list:
    """Broadcasts of (ids, texts), each of about ``block_words`` words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(
        "item_id is not null and length(text) > 0").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // (4 * block_words)))  # a word and its end take four characters at least, on average
    items = Workspace(spark, "decontamination").keep(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    out = []
    for b in range(blocks):
        mine = items.where(F.col("part") == b).select("item_id", "text").toArrow()
        out.append(spark.sparkContext.broadcast((mine.column("item_id").to_numpy(), mine.column("text").combine_chunks())))
    return out


def _clean_task(shipped, text: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*shipped.value)
        for batch in slices(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[search(block, [None] * batch.num_rows, batch.column(text), least)[1]] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", least: float = 0.75,
          block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text overlaps no benchmark item (see :func:`overlaps`). Ids play no part,
    and no row is shuffled."""
    for shipped in _blocks(benchmark, item_id, text, block_words):
        docs = docs.mapInArrow(_clean_task(shipped, text, least), docs.schema)
    return docs
