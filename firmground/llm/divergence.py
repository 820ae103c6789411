"""How the sources of a language differ from each other and from the language, term by term.

Every group (language, source) and every language gives each kept term a share, smoothed by one. Two shares p and q differ by
``floor((p - q)**2 / q)``. Pairs of sources are compared by the sum over all terms; against its language, a source shows its
most over-used terms.

A term is ahead of another one if the group uses it at least as often, the language at most as often, and its name comes
first: then its value is at least as large and it wins ties. So only terms that fewer than ``top`` others dominate in these
three can be among the first ``top``, the *skyband*. Blocks of terms keep their skybands, the skybands of blocks are merged,
and what is left is ranked exactly.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from firmground.llm.store import Workspace, slices
from firmground.llm.terms import coded

#: Every ASCII character that is no letter.
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
SCALE = 1_000_000_000
ROWS, SLOT = 256, 256  # terms taken at once; sources of a language that one task compares with all others
FOUND = "lang string, source string, part string, item string, value long, n long, lang_n long"
_FOUND = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [(c, pa.int64()) for c in ("value", "n", "lang_n")])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and rows by (lang, source, term), summed over some megabytes; an empty term for every group seen."""
    for batch in slices(batches, "text", 8 << 20):
        codes, bounds, terms = coded(batch.column("text"), NO_LETTERS)
        kinds = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        group = kinds[0].indices.to_numpy().astype(np.int64) * len(kinds[1].dictionary) + kinds[1].indices.to_numpy()
        k = max(len(terms), 1)
        in_rows, n = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(bounds)) * k + codes, return_counts=True)
        keys, at = np.unique(group[in_rows // k] * k + in_rows % k, return_inverse=True)
        groups = np.unique(group)
        of = np.concatenate([keys // k, groups])
        names = pa.concat_arrays([terms.take(pa.array(keys % k)), pa.array([""] * len(groups), pa.large_string())]).cast(pa.string())
        sums = [np.concatenate([np.bincount(at, w, len(keys)).astype(np.int64), np.zeros(len(groups), np.int64)]) for w in (n, None)]
        yield pa.RecordBatch.from_arrays(
            [kinds[0].dictionary.take(pa.array(of // len(kinds[1].dictionary))), kinds[1].dictionary.take(pa.array(of % len(kinds[1].dictionary))),
             names, *map(pa.array, sums)], names=["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / total)``, exact in 64 bits: three digits of the quotient at a time."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


class Band:
    """The skyband of a stream of (term, count, count of the language) in the order of the terms."""

    def __init__(self, top: int):
        self.top, self.held = top, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.names: list[str] = []

    def add(self, names: list[str], n: np.ndarray, rest: np.ndarray, value: np.ndarray) -> None:
        """Whoever is dominated by ``top`` others is so by ``top`` of the skyband, so the rest need not be remembered."""
        ahead = ((self.held[0] >= n[:, None]) & (self.held[1] <= rest[:, None])).sum(axis=1)
        ahead += np.tril((n >= n[:, None]) & (rest <= rest[:, None]), -1).sum(axis=1)
        stay = np.flatnonzero(ahead < self.top)
        self.names += [names[i] for i in stay]
        self.held = [np.concatenate([a, b[stay]]) for a, b in zip(self.held, (n, rest, value))]


def _band_rows(lang: str, source: str, band: Band) -> pa.RecordBatch:
    m = len(band.names)
    n, rest, value = band.held
    return pa.RecordBatch.from_arrays([pa.array([lang] * m), pa.array([source] * m), pa.array(["term"] * m), pa.array(band.names, pa.string()),
                                       *map(pa.array, (value, n, rest))], schema=_FOUND)


class Block:
    """Some terms of a language, one after another: sums over pairs of its sources, and the skyband of each source."""

    def __init__(self, header: dict, top: int):
        self.lang, self.sources = header["lang"], header["sources"]
        self.known = pa.array(self.sources, pa.string())
        self.totals = np.array(header["counts"], np.int64) + header["kept"]
        self.lang_total = np.int64(header["lang_n"] + header["kept"])
        self.own = range(header["slot"] * SLOT, min(len(self.sources), (header["slot"] + 1) * SLOT))
        self.sums = np.zeros((len(self.own), len(self.sources)), np.int64)
        self.bands = [Band(top) for _ in self.own]

    def add(self, rows: pa.RecordBatch) -> None:
        lists = rows.column("sources")
        counts = np.zeros((rows.num_rows, len(self.sources)), np.int64)
        at = pc.index_in(lists.flatten(), value_set=self.known).to_numpy()
        counts[np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy()), at] = rows.column("counts").flatten().to_numpy()
        shares = share(counts, self.totals)
        rest = rows.column("lang_n").to_numpy()
        q = share(rest, self.lang_total)
        names = rows.column("term").to_pylist()
        for i, source in enumerate(self.own):
            p, n = shares[:, source], counts[:, source]
            off = p[:, None] - shares
            self.sums[i] += (off * off // shares).sum(axis=0)
            more = np.flatnonzero((n > 0) & (p > q))
            if len(more):
                off = p[more] - q[more]
                self.bands[i].add([names[j] for j in more], n[more], rest[more], off * off // q[more])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for i, source in enumerate(self.own):
            others = [j for j in range(len(self.sources)) if j != source]
            m, zero = len(others), np.zeros(len(others), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * m, pa.string()), pa.array([self.sources[source]] * m, pa.string()), pa.array(["pair"] * m, pa.string()),
                 pa.array([self.sources[j] for j in others], pa.string()), pa.array(self.sums[i][others]), pa.array(zero), pa.array(zero)], schema=_FOUND)
            yield _band_rows(self.lang, self.sources[source], self.bands[i])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of at most ROWS rows with the same keys, in order."""
    for batch in batches:
        columns = [batch.column(c).dictionary_encode() for c in keys]
        codes = np.stack([c.indices.to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            for at in range(low, high, ROWS):
                yield tuple(batch.column(c)[at].as_py() for c in keys), batch.slice(at, min(ROWS, high - at))


def _block_task(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for now, rows in _runs(batches, ["lang", "slot", "block"]):
            if now != key:
                if block:
                    yield from block.rows()
                key, block, rows = now, Block(rows.slice(0, 1).to_pylist()[0], top), rows.slice(1)
            if rows.num_rows:
                block.add(rows)
        if block:
            yield from block.rows()

    return run


def _merge_task(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band = None, None
        for now, rows in _runs(batches, ["lang", "source", "salt"]):
            if now != key:
                if band:
                    yield _band_rows(*key[:2], band)
                key, band = now, Band(top)
            band.add(rows.column("item").to_pylist(), *(rows.column(c).to_numpy() for c in ("n", "lang_n", "value")))
        if band:
            yield _band_rows(*key[:2], band)

    return run


def divergence(docs: DataFrame, top: int = 200, least_docs: int = 3, text: str = "text", lang: str = "lang", source: str = "source",
               block_terms: int = 2000, salts: int = 8) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources of a language, and the ``top`` terms of each source.

    Every row is a document. Null text, lang and source count as empty; groups without terms are compared as well (with 0
    where their language keeps no term) and have no ``term`` rows. Very long texts are read whole. Ties rank by the UTF-8
    of the item, repeated rows count again, an empty table gives no rows, other columns are ignored. A term's occurrences and
    a block of terms are spread over tasks, so no language, source or term is gathered in one; the result has the square
    of a language's sources as rows, and a term's row as many entries as its language has sources.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "divergence")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    counted = known.mapInArrow(_count_task, "lang string, source string, term string, n long, docs long")
    counts = work.keep(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    pairs = F.collect_list(F.struct("source", "n"))
    kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), pairs.alias("by"))
    kept = work.keep(kept.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "by"), "kept")

    totals = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("n")))).alias("by"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_n"))
    header = groups.join(sizes, "lang", "left").select("lang", F.lit("").alias("term"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("kept", "lang_n")), "by")
    blocks = 1 + (sizes.agg(F.max("kept")).first()[0] or 0) // block_terms
    slots = (groups.agg(F.max(F.size("by"))).first()[0] or 1) // SLOT + 1

    heads = header.withColumn("slot", F.explode(F.sequence(F.lit(0), F.floor((F.size("by") - 1) / SLOT).cast("int")))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("int"))))
    places = kept.withColumn("kept", F.lit(0).cast("long")).withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    if slots > 1:  # languages with more sources than one task compares: their terms go to each slot
        many = groups.select("lang", F.floor((F.size("by") - 1) / SLOT).cast("int").alias("last"))
        places = places.join(many, "lang").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    else:
        places = places.withColumn("slot", F.lit(0))
    columns = ["lang", "slot", "block", "term", "kept", "lang_n", F.col("by.source").alias("sources"), F.col("by.n").alias("counts")]
    rows = heads.select(columns).unionByName(places.select(columns)).repartition(parts, "lang", "slot", "block").sortWithinPartitions("lang", "slot", "block", "term")
    found = work.keep(rows.mapInArrow(_block_task(top), FOUND), "found")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    salted = found.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    merged = salted.repartition(parts, "lang", "source", "salt").sortWithinPartitions("lang", "source", "salt", "item").mapInArrow(_merge_task(top), FOUND)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = merged.select(pairs.columns).withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)
