"""Importance resampling towards a target distribution.

Texts are bags of hashed features. How much likelier a feature's bucket is in the target texts than in all documents is its
gain, and a document's weight is the sum of its features' gains, added up in arrays. Gumbel noise of the document's id turns
the largest scores into a draw without replacement with chances by weight.

The cutoff is found without sorting the table: a quantile sketch proposes a bracket of scores, exact counts of what lies
outside of it prove or widen it, and only the rows in the bracket are sorted to find the last one drawn.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from firmground.llm.store import Workspace, slices
from firmground.llm.terms import coded
from firmground.llm.words import PUNCTUATED

PLACES = 33  # bits of a row's place within its partition, as Spark's increasing ids have them


def features(column: pa.Array, buckets: int, longest: int):
    """``(n_words, bounds, hashed)``: features of row i are ``hashed[bounds[i]:bounds[i + 1]]``, the CRC-32 modulo
    ``buckets`` of every run of 1 to ``longest`` of its words, joined by one space."""
    codes, ends, terms = coded(column, PUNCTUATED)
    words = [t.as_py().encode() for t in terms]
    rows = np.repeat(np.arange(len(column)), np.diff(ends))
    crc = np.array([zlib.crc32(w) for w in words], np.int64)
    runs, found, of = codes.astype(np.int64), [crc[codes]], [rows]
    for n in range(2, longest + 1):
        same = rows[n - 1:] == rows[:len(rows) - n + 1]
        pairs = runs[:-1] * len(words) + codes[n - 1:]
        distinct, runs = np.unique(pairs, return_inverse=True)
        crc = np.array([zlib.crc32(b" " + words[p % len(words)], int(crc[p // len(words)])) for p in distinct.tolist()], np.int64)
        found.append(crc[runs][same])
        of.append(rows[n - 1:][same])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(column)))])
    return np.diff(ends), bounds, (np.concatenate(found) % buckets)[order]


def _count_task(text: str, buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, text):
            total += np.bincount(features(batch.column(text), buckets, longest)[2], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """Features of all rows by bucket; what reaches the driver is one number per bucket."""
    counted = texts.select(text).mapInArrow(_count_task(text, buckets, longest), "bucket long, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by which a bucket is likelier in the target, each bucket counted once more than seen."""
    n = len(source)
    odds = (target + 1.0) * (source.sum() + float(n)) / ((source + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def _weigh_task(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, bounds, hashed = features(batch.column("text"), len(gain), longest)
            sums = np.concatenate([[0], np.cumsum(gain[hashed])])
            weight = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_words, np.diff(bounds), weight))],
                names=["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that follows from the seed and the id alone (a null id counts as empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(u)))


def ordered(df: DataFrame, order: list[Column], work: Workspace, name: str) -> DataFrame:
    """``df`` with ``rank`` 1, 2, 3, … in a global order: a range partitioning, places within it, and the rows before each
    partition, of which there is one number per partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = work.keep(placed, name)
    part = F.shiftright("_at", PLACES)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_part long, _before long")  # one row per partition
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACES) - 1))
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(*df.columns, (F.col("_before") + place + 1).alias("rank"))


def bracket(df: DataFrame, n: int, k: int, slack: float = 0.005):
    """``(low, high, above)``: the k-th highest of n scores lies in low..high and ``above`` scores are higher than high.

    A sketch proposes the bracket; exact counts outside of it prove it, or it is widened. Ends are None where it is open.
    """
    score, at = F.col("score"), 1 - (k - 0.5) / n
    while True:
        low, high = df.agg(F.percentile_approx("score", [max(at - slack, 0.0), min(at + slack, 1.0)], 2000)).first()[0] if slack < 1 else (None, None)
        over = F.lit(False) if high is None else score > high
        within = ~over & (F.lit(True) if low is None else score >= low)
        above, inside = df.agg(F.count_if(over), F.count_if(within)).first()
        if above < k <= above + inside:
            return low, high, above
        slack *= 4


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, buckets: int = 10_000,
             longest: int = 1, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", slack: float = 0.005) -> DataFrame:
    """Draw ``share`` percent (rounded down) of the documents with at least ``least_words`` words.

    Returns one row per document: ``doc_id, n_words, n_features, weight, score, rank``; rank is 1, 2, 3, … from the highest
    score (ties: smaller id, a null id last) and null for documents not drawn. A null or empty text, or one without letters
    and digits, has weight 0 and is never drawn while ``least_words`` is positive. Very long texts are read whole; their
    weight is a sum like any other. Repeated rows and ids are rows of their own. An empty target or an empty table gives
    gains from the added counts alone, or no rows. Other columns, of whatever name, are ignored.
    """
    work = Workspace(docs.sparkSession, "resampling")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gain = gains(*(bucket_counts(t, "text", buckets, longest) for t in (source, target.select(F.col(text).alias("text")))))
    kind = source.schema["doc_id"].dataType.simpleString()
    weighed = source.mapInArrow(_weigh_task(gain, longest), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = work.keep(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    fit = F.col("n_words") >= least_words
    able = scored.where(fit)
    n = able.count()
    k = share * n // 100
    none = F.lit(None).cast("long")
    if not k:
        return scored.withColumn("rank", none)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.desc("n_words")]
    low, high, above = bracket(able, n, k, slack)
    near = able.where((F.lit(True) if low is None else F.col("score") >= low) & (F.lit(True) if high is None else F.col("score") <= high))
    last = ordered(near, order, work, "bracket").where(F.col("rank") == k - above).first()
    missing, id_ = F.lit(last.doc_id is None), F.lit(last.doc_id)
    ahead = F.when(F.col("score") == last.score, missing | (F.col("doc_id") <= id_)).otherwise(F.col("score") > last.score)
    drawn = fit & F.coalesce(ahead, F.lit(False))
    ranks = ordered(scored.where(drawn), order, work, "drawn")
    return ranks.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(scored.where(~drawn).withColumn("rank", none))
