"""Exact deduplication over an extendible-hash index kept in shared files.

1. *Log.* Each map task normalises its texts, chains texts of equal hash by comparing bytes, and writes one row per
   document to a shared table; only the first document of a distinct text carries the bytes. A text that a third of
   all rows repeat is thus one entry per map task, whatever its number of copies.
2. *Directory.* Entries are counted by the leading hash bits. A bucket over its capacity splits, and the directory
   doubles when the split bucket is as deep as the directory. The directory holds at most ``2 ** max_depth`` numbers,
   a bound that does not grow with the data, so it is kept on the driver and broadcast.
3. *Owners.* Each bucket belongs to one task, which streams its entries in hash order. Entries of equal hash form a
   chain in which bytes are compared again; a hash held by a single entry needs no bytes at all and stays at home.
   Owners write the buckets of the index to shared files, one sorted file each.
4. The log is joined with the index by entry number, which no map task repeats more often than it has rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from firmground.llm.store import Workspace, slices, unused

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOG = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("sha", pa.string()),
                  ("entry", pa.int64()), ("hash", pa.int64()), ("body", pa.binary())])
LOG = "row long, doc_id long, size long, sha string, entry long, hash long, body binary"
_OWNED = pa.schema([("bucket", pa.int32()), ("hash", pa.int64()), ("entry", pa.int64()), ("keep_id", pa.int64()),
                    ("keep_row", pa.int64()), ("group_size", pa.int64())])
OWNED = "bucket int, hash long, entry long, keep_id long, keep_row long, group_size long"


def _hash(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def _log_task(held_bytes: int, hash_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, made, held = TaskContext.get().partitionId() << 33, 0, 0, 0
        chains: dict[int, list[tuple[bytes, int]]] = {}
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                text = text or ""
                body = text.encode("utf-8", "surrogatepass").translate(None, SPACE)
                key = hash_of(body)
                chain = chains.setdefault(key, [])
                entry = next((e for b, e in chain if b == body), None)
                first = entry is None
                if first:
                    entry = base + made
                    made += 1
                    chain.append((body, entry))
                    held += len(body)
                for col, value in zip(cols, (len(text), hashlib.sha256(body).hexdigest(), entry, key, body if first else None)):
                    col.append(value)
            number = pa.array(np.arange(base + rows, base + rows + batch.num_rows))
            rows += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [number, batch.column("doc_id")] + [pa.array(c, f.type) for c, f in zip(cols, list(_LOG)[2:])], schema=_LOG)
            if held > held_bytes:  # forgetting only means one more entry of the same text
                chains, held = {}, 0

    return run


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, np.ndarray, list[int]]:
    """``(depth, slots, depths)`` from entry counts by the first ``max_depth`` hash bits.

    ``slots[prefix of depth bits]`` is a bucket number; ``depths`` holds each bucket's own depth. A bucket splits while it
    is over capacity and less deep than ``max_depth``.
    """
    cells = np.zeros(1 << max_depth, np.int64)
    for prefix, n in counts.items():
        cells[prefix] = n
    upto = np.concatenate([[0], np.cumsum(cells)])
    depth, slots, depths = 0, np.zeros(1, np.int64), [0]
    todo = [(0, 0)]  # bucket, prefix
    while todo:
        bucket, prefix = todo.pop()
        own = depths[bucket]
        width = 1 << (max_depth - own)
        if own == max_depth or upto[(prefix + 1) * width] - upto[prefix * width] <= capacity:
            continue
        if own == depth:  # the directory doubles
            slots, depth = np.repeat(slots, 2), depth + 1
        twin = len(depths)
        depths[bucket] += 1
        depths.append(own + 1)
        span = 1 << (depth - own - 1)
        slots[(prefix * 2 + 1) * span:(prefix * 2 + 2) * span] = twin
        todo += [(bucket, prefix * 2), (twin, prefix * 2 + 1)]
    return depth, slots, depths


def _owner_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by (bucket, hash); a link of the chain is [bytes, entries, best row, number of rows]."""
    state: tuple | None = None
    chain: list[list] = []
    out: list[tuple] = []

    def close():
        for _, entries, best, rows in chain:
            out.extend((*state, e, best[2] if not best[1] else None, best[3], rows) for e in entries)

    def table():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OWNED)], schema=_OWNED)

    for batch in batches:
        for r in batch.to_pylist():
            at = (r["bucket"], r["hash"])
            if at != state:
                if state is not None:
                    close()
                state, chain = at, []
            best = (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["row"])
            for link in chain:
                if link[0] == r["body"]:
                    link[1].append(r["entry"])
                    link[2], link[3] = min(link[2], best), link[3] + r["n"]
                    break
            else:
                chain.append([r["body"], [r["entry"]], best, r["n"]])
        if len(out) > 10_000:
            yield table()
            out.clear()
    if state is not None:
        close()
    if out:
        yield table()


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4_000,
                 max_depth: int = 14, held_bytes: int = 64 << 20, hash_of=_hash) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``, plus the index ``bucket`` of repeated texts.

    Texts are equal when identical after deleting ASCII white space. The row with the most code points of original
    text stays, then the smallest id. A null text counts as empty; empty texts form one group. A null id sorts after
    all others, and its group may name null as ``keep_id`` only if it holds no id of that length. Repeated rows with
    one id are separate members and exactly one row of a group has ``kept``. Other columns are ignored; an empty table
    gives an empty result.

    ``capacity`` is the number of entries in a bucket before it splits, ``held_bytes`` how much text a map task keeps
    for its chains. Neither changes the result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    log = work.keep(source.mapInArrow(_log_task(held_bytes, hash_of), LOG), "log")
    ranked = F.struct((-F.col("size")).alias("s"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    best = log.groupBy("entry").agg(F.min(ranked).alias("b"), F.count(F.lit(1)).alias("n")).select(
        "entry", (-F.col("b.s")).alias("size"), F.col("b.d").alias("doc_id"), F.col("b.r").alias("row"), "n")
    heads = log.where("body is not null")
    # Only a hash with more than one entry needs an owner.
    shared = heads.groupBy("hash").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    prefix = F.shiftrightunsigned(F.col("hash"), 64 - max_depth)
    cells = {r["p"]: r["n"] for r in shared.groupBy(prefix.alias("p")).agg(F.sum("entries").alias("n")).collect()}
    depth, slots, _ = directory(cells, capacity, max_depth)
    slot_table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(slots)], "slot long, bucket int")
    slot = F.shiftrightunsigned(F.col("hash"), 64 - depth) if depth else F.lit(0).cast("long")
    owned = (
        heads.select("hash", "entry", "body").join(shared, "hash")
        .withColumn("slot", slot).join(F.broadcast(slot_table), "slot")  # at most 2 ** max_depth rows
        .join(best, "entry")
        .select("bucket", "hash", "entry", "body", "size", "doc_id", "row", "n")
        .repartition("bucket").sortWithinPartitions("bucket", "hash", "entry")
        .mapInArrow(_owner_task, OWNED)
    )
    index = work.keep(owned, "index").select("entry", "bucket", "keep_id", "keep_row", "group_size")
    found = best.join(index, "entry", "left").select(
        "entry", "bucket", F.when(F.col("bucket").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("group_size", "n").alias("group_size"))
    return log.select("row", "doc_id", "sha", "entry").join(found, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"), "bucket")


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts (see :func:`exact_groups`)."""
    id_, sha, turn = unused(["_stay_id", "_stay_sha", "_stay_turn"], docs.columns)
    ident = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias(id_)
    stay = exact_groups(docs, doc_id, text, **how).where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_), F.col("text_sha256").alias(sha))
    body = F.translate(F.coalesce(F.col(text), F.lit("")), SPACE.decode(), "")
    marked = docs.select("*", ident, F.sha2(body, 256).alias(sha)).join(stay.hint("merge"), [id_, sha])
    # the join has brought repeated rows of one id and text together: the longest original stays
    order = Window.partitionBy(id_, sha).orderBy(F.desc(F.length(F.coalesce(F.col(text), F.lit("")))))
    return marked.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(docs.columns)
