"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Each document becomes the set of its hashed word shingles and a signature of ``4 * trees`` minima. Equal sets collapse to
   the smallest id, so exact copies, however many, enter the forest once.
2. Tree t sorts the signatures by eight of its minima; the first four of each tree belong to no other tree. The forest is
   range-partitioned in that order, hence a region of very many near copies spreads over tasks; the rows at the edges of
   partitions are paired afterwards.
3. Candidates are the next neighbours in each order that share at least the first four minima. In a crowded region the
   neighbours share more of them, so the depth of comparison follows the region.
4. Candidates are confirmed on the full sets, first those of each document with the longest common prefixes. A pair whose
   ends are joined by then needs no test; every other candidate is tested in a second round. At similarity 0.75 a pair shares the prefix of some tree with
   a probability of 1 - (1 - 0.75 ** 4) ** 32 > 0.99999.
5. Where more rows share a prefix than neighbours reach, and are not all joined by then, no order can bring every pair together
   (a family on one template holds far more rows at 0.6 than one can look through). The documents there are joined exactly:
   in one order of all shingles, frequent ones last, two sets that are similar enough share one of their first shingles,
   and the places of the first they share bound what they can have in common. The order comes from counts of a sample,
   which changes only the work. All pairs that pass are confirmed on the full sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from firmground.llm.graph import components
from firmground.llm.store import Workspace, release, slices, text_bytes, unused
from firmground.llm.words import mix, shingles, words

DEPTH = 4
SIGNED = "doc_id long, n long, k1 long, k2 long, signature binary"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("signature", pa.binary())])
PAIRS = "part int, edge int, prefix long, hi long, lo long, a long, b long, lcp int"
_PAIRS = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("prefix", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                    ("a", pa.int64()), ("b", pa.int64()), ("lcp", pa.int32())])


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    hashes, bounds, _, _ = words(data, offsets)
    made, at = shingles(hashes, bounds, size)
    return [np.unique(made[at[i]:at[i + 1]]) for i in range(len(offsets) - 1)]


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return (rng.integers(0, 2**32, count, np.uint32) | np.uint32(1)), rng.integers(0, 2**32, count, np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of ``a * x + b`` modulo 2**32 over the folded hashes, in blocks of bounded size."""
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 4096):
        part = np.multiply.outer(a, folded[i:i + 4096])
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sign_task(size: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        a, b = _coefficients(DEPTH * trees)
        for batch in slices(batches, "text", 1 << 20):
            n, k1, k2, sig = [], [], [], []
            for found in shingle_sets(batch.column("text"), size):
                n.append(len(found))
                if len(found):
                    key = xxhash.xxh3_128_digest(found.tobytes())
                    k1.append(int.from_bytes(key[:8], "big", signed=True))
                    k2.append(int.from_bytes(key[8:], "big", signed=True))
                    sig.append(signature(found, a, b).tobytes())
                else:
                    k1.append(None)
                    k2.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [
                pa.array(c, f.type) for c, f in zip((n, k1, k2, sig), list(_SIGNED)[1:])], schema=_SIGNED)

    return run


def _orders(trees: int) -> np.ndarray:
    """Signature positions of each tree: four of its own, then four drawn from the others."""
    rng = np.random.default_rng(5)
    own = rng.permutation(DEPTH * trees).reshape(trees, DEPTH)
    return np.array([np.concatenate([o, rng.permutation(np.setdiff1d(np.arange(DEPTH * trees), o))[:4]]) if trees > 1
                     else np.concatenate([o, o]) for o in own])


def _tree_task(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(trees)
        steps = mix(np.arange(1, DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
        sign = np.uint64(1) << np.uint64(63)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(part.num_rows, -1)
                label = sig[:, orders].astype(np.uint64)  # row, tree, place
                prefix = mix((label[:, :, :DEPTH] * steps).sum(axis=2, dtype=np.uint64) + np.arange(trees, dtype=np.uint64))
                hi = ((label[:, :, 4] << np.uint64(32)) | label[:, :, 5]) ^ sign
                lo = ((label[:, :, 6] << np.uint64(32)) | label[:, :, 7]) ^ sign
                ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), trees)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.reshape(-1).view(np.int64)) for x in (prefix, hi, lo)] + [pa.array(ids)],
                    names=["prefix", "hi", "lo", "id"])

    return run


def _common(hi, lo, hi2, lo2) -> np.ndarray:
    """Length of the common prefix of two rows that share the first four minima."""
    x, y = (hi ^ hi2).view(np.uint64), (lo ^ lo2).view(np.uint64)
    half = np.uint64(0xFFFFFFFF00000000)
    return (DEPTH + ((x & half) == 0).astype(np.int32) + (x == 0) + ((x == 0) & ((y & half) == 0)) + ((x == 0) & (y == 0))).astype(np.int32)


def _neighbour_task(reach: int):
    """Pairs of neighbours up to ``reach`` places apart, and the first and last ``reach`` rows of the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, lead = TaskContext.get().partitionId(), None, None

        def edge(rows, kind):
            m = len(rows[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, kind, np.int32)), *map(pa.array, rows),
                 pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], schema=_PAIRS)

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            fresh = 0 if held is None else len(held[0])
            if lead is None or len(lead[0]) < reach:
                lead = [x[:reach] for x in rows] if held is None or len(held[0]) < reach else lead
            for step in range(1, reach + 1):
                i = np.arange(max(0, fresh - step), len(rows[0]) - step)
                i = i[rows[0][i] == rows[0][i + step]]
                i = i[rows[3][i] != rows[3][i + step]]
                if len(i):
                    j = i + step
                    a, b = rows[3][i], rows[3][j]
                    none = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(len(i), pa.int32()), pa.nulls(len(i), pa.int32()), none, none, none, pa.array(np.minimum(a, b)),
                         pa.array(np.maximum(a, b)), pa.array(_common(rows[1][i], rows[2][i], rows[1][j], rows[2][j]))], schema=_PAIRS)
            # rows of a run longer than neighbours reach, or of one that a batch border cuts
            runs = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
            sizes = np.diff(np.append(runs, len(rows[0])))
            wide = sizes > reach + 1
            wide[[0, -1]] = True
            crowd = np.repeat(wide, sizes)
            m = int(crowd.sum())
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int32()), pa.array(np.full(m, 2, np.int32)), pa.array(rows[0][crowd]), none, none, pa.array(rows[3][crowd]),
                 none, pa.nulls(m, pa.int32())], schema=_PAIRS)
            held = [x[-reach:] for x in rows]
        if held is not None and len(held[0]):
            yield edge(lead, 0)
            yield edge(held, 1)

    return run


def _edge_pairs(rows: list, reach: int) -> list[tuple]:
    """Pairs across partition borders. ``rows`` are at most ``2 * reach`` per partition."""
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r["part"], r["edge"]), []).append((r["prefix"], r["a"]))
    parts = sorted({p for p, _ in by})
    out = []
    for p, q in zip(parts, parts[1:]):
        for x in by.get((p, 1), ()):
            for y in by.get((q, 0), ()):
                if x[0] == y[0] and x[1] != y[1]:
                    out.append((min(x[1], y[1]), max(x[1], y[1]), DEPTH))
    return out


def _confirm_task(size: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(slices([whole], "ta", 1 << 20), "tb", 1 << 20):
                keep = []
                for x, y in zip(shingle_sets(batch.column("ta"), size), shingle_sets(batch.column("tb"), size)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and both >= share * (len(x) + len(y) - both) - 1e-9)
                yield batch.select(["a", "b"]).append_column("linked", pa.array(keep, pa.bool_()))

    return run


def _shingle_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = shingle_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["token"])

    return run


def _first_task(shipped, size: int, share: float):
    """The shingles of each set that two similar sets must share one of: the first ones, rare before frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shipped.value
        for batch in slices(batches, "text"):
            ids, groups = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "c"))
            token, row, n, place = [], [], [], []
            for i, found in enumerate(shingle_sets(batch.column("text"), size)):
                often = np.zeros(len(found), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    often = np.where(common[at] == found, count[at], 0)
                first = found[np.lexsort((found, often))[:len(found) - int(np.ceil(share * len(found) - 1e-9)) + 1]]
                token.append(first.view(np.int64))
                row.append(np.full(len(first), i))
                n.append(np.full(len(first), len(found), np.int32))
                place.append(np.arange(len(first), dtype=np.int32))
            row = np.concatenate(row)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(token), ids[row], groups[row], np.concatenate(n), np.concatenate(place))],
                                             names=["token", "id", "c", "n", "place"])

    return run


def _crowded_links(near: DataFrame, source: DataFrame, joined: DataFrame, work: Workspace, size: int, share: float,
                   sampled: int = 8_000_000, most: int = 500_000) -> DataFrame | None:
    """``a, b``: every pair over ``share`` of two components among the documents of crowded regions, or None if there are none."""
    spark = source.sparkSession
    crowd = near.where("edge = 2").select("prefix", F.col("a").alias("id")).distinct().join(joined, "id", "left").select(
        "prefix", "id", F.coalesce("component", "id").alias("c"))
    crowd = work.keep(crowd, "crowd")
    split = crowd.groupBy("prefix").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l < h").select("prefix")
    who = work.keep(crowd.join(split.hint("shuffle_hash"), "prefix", "left_semi").select(F.col("id").alias("doc_id"), "c").distinct(), "crowded")
    if who.isEmpty():
        return None
    texts = work.keep(source.join(who.hint("shuffle_hash"), "doc_id").distinct(), "crowded-texts")
    words_in = texts.agg(F.sum(F.length("text"))).first()[0] // 6
    part = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(int(words_in // sampled + 1))) == 0)
    often = part.mapInArrow(_shingle_task(size), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(
        F.desc("n"), "token").limit(most).toArrow()  # most rows
    common, count = often.column("token").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(common)
    shipped = spark.sparkContext.broadcast((common[order], count[order]))
    firsts = work.keep(texts.mapInArrow(_first_task(shipped, size, share), "token long, id long, c long, n int, place int"), "firsts")
    need = F.lit(share / (1 + share)) * (F.col("s.n") + F.col("t.n")) - 1e-6
    # as the smaller set of a pair, a set must have the shingle early; a hot shingle is left to the skew handling of the join
    small, large = firsts.where(f"n - place >= {2 * share / (1 + share)} * n - 1e-6").alias("s"), firsts.alias("t")
    met = small.join(large.hint("merge"), (F.col("s.token") == F.col("t.token")) & (F.col("s.c") != F.col("t.c")) & (F.col("s.n") <= F.col("t.n")) & (
        F.col("s.n") >= share * F.col("t.n") - 1e-6) & (F.col("s.n") - F.col("s.place") >= need) & (F.col("t.n") - F.col("t.place") >= need))
    pairs = work.keep(met.select(F.least("s.id", "t.id").alias("a"), F.greatest("s.id", "t.id").alias("b")).distinct(), "crowded-pairs")
    bodies = texts.select("doc_id", "text")
    return work.keep(pairs.join(bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(
        _confirm_task(size, share), "a long, b long, linked boolean").where("linked").select("a", "b").distinct(), "crowded-links")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, share: float = 0.75,
                trees: int = 32, reach: int = 2) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when the Jaccard similarity of their sets of ``size``-word shingles is ``share`` or more; A-Z count
    as a-z and words end at ASCII white space. A text with fewer words is one shingle; one without words (null, empty) has
    no shingle, links with nothing and stays. ``component_id`` is the smallest id reachable over links. Rows that repeat an
    id count as one document: they share its component, and each has its own ``n_shingles``. A row with a null id is never
    linked: its component is null and it stays. Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "near-dedup")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = work.keep(source.mapInArrow(_sign_task(size, trees), SIGNED), "signed")
    known = signed.where("doc_id is not null and k1 is not null")
    sets = work.keep(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "sets")
    reps = known.join(sets.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"]).select("doc_id", "signature")
    forest = work.keep(reps.mapInArrow(_tree_task(trees), "prefix long, hi long, lo long, id long"), "forest")
    ordered = forest.repartitionByRange("prefix", "hi", "lo", "id").sortWithinPartitions("prefix", "hi", "lo", "id")
    near = work.keep(ordered.mapInArrow(_neighbour_task(reach), PAIRS), "near")
    across = _edge_pairs(near.where("part is not null").collect(), reach)  # 2 * reach rows per partition
    pairs = near.where("edge is null").select("a", "b", "lcp").union(
        docs.sparkSession.createDataFrame(across, "a long, b long, lcp int"))
    pairs = work.keep(pairs.groupBy("a", "b").agg(F.max("lcp").alias("lcp")), "pairs-0")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # the candidates grow with the corpus, so they are never broadcast
    bodies = work.keep(source.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    # A repeated id with several different sets ties those sets together.
    mixed = known.groupBy("doc_id").agg(F.min("k1").alias("l"), F.max("k1").alias("h")).where("l <> h").select("doc_id")
    links = work.keep(known.join(mixed, "doc_id", "left_semi").join(sets, ["k1", "k2"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct(), "links-0")
    joined, turn, picks = None, 0, 3
    while not pairs.isEmpty():
        turn += 1
        first = Window.partitionBy("a").orderBy(F.desc("lcp"), "b")  # an id has at most 2 * reach * trees pairs
        second = Window.partitionBy("b").orderBy(F.desc("lcp"), "a")
        ranked = work.keep(pairs.withColumn("r", F.least(F.row_number().over(first), F.row_number().over(second))), f"ranked-{turn}")
        tried = ranked.where(F.col("r") <= picks).select("a", "b")
        done = tried.join(bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
            bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").mapInArrow(
            _confirm_task(size, share), "a long, b long, linked boolean").where("linked").select("a", "b")
        found = work.keep(done.distinct(), f"found-{turn}")
        edges = links if joined is None else joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
        joined = components(edges.union(found), work, f"components-{turn}")
        left = ranked.where(F.col("r") > picks).select("a", "b", "lcp")
        for end in ("a", "b"):
            left = left.join(joined.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}")), end, "left")
        pairs = work.keep(left.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "lcp"), f"pairs-{turn}")
        picks = 2 * reach * trees  # all that are left
    if joined is None:
        joined = components(links, work)
    missed = _crowded_links(near, source, joined, work, size, share)
    if missed is not None and not missed.isEmpty():
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(missed), work, "components-crowded")
    of_set = sets.join(joined, sets["rep"] == joined["id"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    rows = signed.select("doc_id", "n", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its component; rows with a null id stay."""
    (gone,) = unused(["_gone"], docs.columns)
    found = near_groups(docs, doc_id, text, **how).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(doc_id).cast("long") == F.col(gone), "left_anti")
