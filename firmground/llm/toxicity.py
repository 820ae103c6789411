"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Both models predict the bytes of a word from the six before it. The highest order has counts of its own for the toxic and
for the ordinary class; all lower orders are continuation counts over the distinct words of *all* documents, shared by
both classes, and so is the highest order over all documents, to which each class backs off with the weight of
``STRENGTH`` further observations. A rare expression is thus judged by what its class has really seen and otherwise alike.

A text's two log-likelihoods are compared per byte over all its words, and per word over the words in whose spelling the
toxic model beats the ordinary one by more than ``EXCESS`` nats: in a long text the many words that say nothing would
else drown the few that do. A logistic curve, fitted on labelled rows left out of the counts it uses, maps these
length-normalised differences to 0..1.

Labels come from at most ``max_labels`` labelled rows (those with the smallest hash of their id). The shared counts cover every
document and stay in Spark's tables. The two models can only differ on grams that labelled rows hold and after contexts that
they hold, so what is gathered and travels to the tasks are these grams and contexts with the difference of the models, exactly
and bounded by the labelled texts however large the corpus is.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from firmground.llm.store import Workspace, ragged, release, slices, text_bytes, unused
from firmground.llm.words import PUNCTUATED, words

ORDER = 7
DISCOUNT, STRENGTH = 0.75, 40.0
EXCESS = (2.0, 4.0)
SUMS = ["_tox_total", "_tox_bytes", "_tox_words", "_tox_over_low", "_tox_over_high"]
SCORE = "_tox_score"
ROUND = ["t0", "o0", "t1", "o1"]  # toxic and ordinary counts of the rows that fit and of those that calibrate
ALL = ["n", *ROUND]
_GRAMS = pa.schema([("gram", pa.int64())] + [(c, pa.int64()) for c in ALL])


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def spelled(column: pa.Array):
    """``(inverse, bounds, grams, gram_word)`` of many texts: distinct words, and the grams each is spelled with.

    A gram packs ``ORDER`` bytes: zero before the first byte of the word, a space after its last.
    """
    data, offsets = text_bytes(column)
    hashes, bounds, starts, ends = words(data, offsets, PUNCTUATED)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (ends - starts)[first]
    flat = np.zeros(int((lengths + ORDER).sum()), np.uint8)
    at = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    flat[ragged(at + ORDER - 1, lengths)] = _lower()[data[ragged(starts[first], lengths)]]
    flat[at + ORDER - 1 + lengths] = 32
    grams = np.zeros(int((lengths + 1).sum()), np.uint64)
    place = ragged(at, lengths + 1)
    for j in range(ORDER):
        grams = (grams << np.uint64(8)) | flat[place + j].astype(np.uint64)
    return inverse, bounds, grams, np.repeat(np.arange(len(first)), lengths + 1)


def _summed(parts: list) -> list:
    grams = np.concatenate([p[0] for p in parts])
    keys, inverse = np.unique(grams, return_inverse=True)
    return [(keys, *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(keys)) for i in range(1, 6)))]


def _count_task(held: int = 700_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts: list = []
        for batch in slices(batches, "text", 1 << 20):
            inverse, bounds, grams, of = spelled(batch.column("text"))
            kind = batch.column("kind").to_numpy(zero_copy_only=False)  # 0 unlabelled, else 1 + place in ROUND
            kinds = np.repeat(kind, np.diff(bounds))
            n = int(of[-1]) + 1 if len(of) else 0
            parts.append((grams, np.bincount(inverse, minlength=n)[of].astype(float),
                          *(np.bincount(inverse[kinds == i], minlength=n)[of].astype(float) for i in range(1, 5))))
            if sum(len(p[0]) for p in parts) > held:
                parts = _summed(parts)
                if len(parts[0][0]) > held // 2:
                    yield _batch(parts.pop())
        if parts:
            yield _batch(_summed(parts)[0])

    return run


def _batch(part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64))] + [pa.array(c.astype(np.int64)) for c in part[1:]], schema=_GRAMS)


def _backed_off(count: Column, total: Column, kinds: Column, lower: Column, strength: float = 0.0) -> Column:
    """Interpolated absolute discounting; the lower order where nothing is counted."""
    spare = F.least(DISCOUNT * F.greatest(kinds, F.lit(1)), total) + strength
    p = (F.greatest(count - DISCOUNT, F.lit(0.0)) + spare * lower) / F.greatest(total + strength, F.lit(1.0))
    return F.when(total + strength > 0, p).otherwise(lower)


def _suffix(k: int, gram: str = "gram") -> Column:
    """The last ``k`` bytes of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << (8 * k)) - 1))


def _context() -> Column:
    """What stands before the last byte of a gram."""
    return F.shiftrightunsigned("gram", 8)


def _shared(grams: DataFrame, seen: DataFrame, work: Workspace) -> DataFrame:
    """``gram, low``: over all documents, the probability of the last byte of each gram in ``seen``.

    Order by order from the shortest, continuation counts of all grams meet the suffixes asked for. A context has at most
    256 grams and a suffix at most 256 longer ones, so no key of these windows and joins is hot.
    """
    levels = {ORDER: grams.select("gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        level = levels[k + 1].groupBy(_suffix(k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = work.keep(level, f"order-{k}")
    low = None
    for k in range(1, ORDER + 1):
        context = Window.partitionBy(_context())
        counted = levels[k].select("gram", "n", F.sum("n").over(context).alias("total"), F.count(F.lit(1)).over(context).alias("kinds"))
        counted = counted.join(seen.select(_suffix(k).alias("gram")).distinct(), "gram")
        if low is None:
            counted = counted.withColumn("low", F.lit(1 / 256))
        else:
            counted = counted.join(low.withColumnRenamed("gram", "shorter"), _suffix(k - 1) == F.col("shorter"))
        counted = counted.select("gram", _backed_off(F.col("n"), F.col("total"), F.col("kinds"), F.col("low")).alias("low"))
        low = work.keep(counted, f"shared-{k}") if k in (3, 5, ORDER) else counted
    return low


SIDES = [("fit", ["t0"], ["o0"]), ("all", ["t0", "t1"], ["o0", "o1"])]


class Ratios:
    """Differences of the classes' log-probabilities, exactly by gram: first of the grams that labelled rows hold, then of
    any other gram after a context that they hold. Everywhere else the classes agree. The size is bounded by the texts of
    at most ``max_labels`` rows."""

    def __init__(self, grams: pa.Table, contexts: pa.Table, side: str):
        self.known = [self._sorted(t, side) for t in (grams, contexts)]

    @staticmethod
    def _sorted(found: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
        keys = found.column("gram").to_numpy()
        order = np.argsort(keys)
        return keys[order], found.column(side).to_numpy()[order]

    def of(self, grams: np.ndarray) -> np.ndarray:
        keys, place = np.unique(grams.view(np.int64), return_inverse=True)
        out = np.zeros(len(keys), np.float32)
        for (known, values), wanted in zip(reversed(self.known), (keys >> 8, keys)):
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                out = np.where(known[at] == wanted, values[at], out)
        return out[place]


def learned_ratios(grams: DataFrame, work: Workspace) -> dict[str, Ratios]:
    """The :class:`Ratios` of the rows that fit, and of all labelled rows, from the counts of every gram of the corpus."""
    seen = work.keep(grams.where("t0 + o0 + t1 + o1 > 0").select("gram", *ROUND), "seen")
    count = lambda names: sum((F.col(c) for c in names), F.lit(0))
    sums = [(f"{kind}_{name}_{side}", agg) for name, *both in SIDES for side, names in zip("to", both)
            for kind, agg in (("n", F.sum(count(names))), ("k", F.count_if(count(names) > 0)))]

    def ratio(name: str, counts: list[Column], low: Column) -> Column:
        p = [_backed_off(c, F.col(f"n_{name}_{side}"), F.col(f"k_{name}_{side}"), low, STRENGTH) for side, c in zip("to", counts)]
        return F.log(p[0] / p[1]).cast("float").alias(name)

    over = Window.partitionBy(_context())
    told = seen.join(_shared(grams, seen, work), "gram").select("*", *[x.over(over).alias(n) for n, x in sums])
    contexts = seen.groupBy(_context().alias("gram")).agg(*[x.alias(n) for n, x in sums])
    by_gram = told.select("gram", *[ratio(name, [count(t), count(o)], F.col("low")) for name, t, o in SIDES]).toArrow()  # bounded by the labelled texts
    by_context = contexts.select("gram", *[ratio(name, [F.lit(0), F.lit(0)], F.lit(1.0)) for name, _, _ in SIDES]).toArrow()
    return {name: Ratios(by_gram, by_context, name) for name, _, _ in SIDES}


def features(sums: np.ndarray) -> np.ndarray:
    """The compared quantities from the rows of ``SUMS``; :func:`toxicity` states the same as columns."""
    total, size, n, low, high = sums
    n = np.maximum(n, 1)
    return np.stack([np.log(low / n + 0.005), np.log(high / n + 0.005), np.log(n + 1), total / np.maximum(size, 1), np.ones(len(n))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps on scaled features."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12) if len(x) else np.ones(x.shape[1])
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _score_task(shipped, keep: list[str], text: str = "text", sums: list[str] = SUMS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ratios = shipped.value
        for batch in slices(batches, text, 1 << 20):
            inverse, bounds, grams, word = spelled(batch.column(text))
            m = int(word[-1]) + 1 if len(word) else 0
            by_word = np.bincount(word, ratios.of(grams), m)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            per_word = [by_word, np.bincount(word, minlength=m), np.ones(m), *(np.maximum(by_word - x, 0) for x in EXCESS)]
            found = [np.bincount(rows, x[inverse], batch.num_rows).astype(float) for x in per_word]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x) for x in found], names=[*keep, *sums])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
             max_labels: int = 200_000) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, log_ratio, n_words``.

    Rows whose ``crc32(doc_id as text) mod 5`` is 0 are held out: their labels are never used. Of the others, 1-3 fit and
    4 calibrates; the final counts use both. A null or empty text, or one without letters and digits, has no evidence
    either way and gets the curve's value for no words. Labels with a null id or null label are ignored, of repeated
    labels of an id the largest counts; repeated or null-id documents are scored row by row (a null id counts as held
    out). Without labels of both classes every score is the share of toxic labels, or 0. Other columns are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    judge = fitted(docs, labels, doc_id, text, label, max_labels)
    return judge(source, "text", ["doc_id"], [*SUMS, SCORE]).select(
        "doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), F.col(SCORE).alias("score"),
        (F.col(SCORE) >= 0.5).cast("int").alias("predicted"), F.col(SUMS[0]).alias("log_ratio"), F.col(SUMS[2]).cast("long").alias("n_words"))


def kept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below one half (see :func:`toxicity`); no row is shuffled."""
    judge = fitted(docs, labels, doc_id, text, **how)
    names = unused([*SUMS, SCORE], docs.columns)
    return judge(docs, text, docs.columns, names).where(F.col(names[-1]) < 0.5).select(docs.columns)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           max_labels: int = 200_000):
    """Fits the models and returns a function ``(rows, text column, columns to keep, names)`` that adds ``SUMS`` and ``SCORE`` by
    those names."""
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learn = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        "doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(fold != 0)
    learn = work.keep(learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "labels")  # max_labels rows at most
    place = F.when(F.col("y").isNull(), 0).otherwise(F.when(F.col("y") > 0, 1).otherwise(2) + F.when(fold == 4, 2).otherwise(0))
    marked = source.join(F.broadcast(learn), "doc_id", "left").select("text", place.cast("int").alias("kind"))
    counted = marked.mapInArrow(_count_task(), "gram long, " + ", ".join(f"{c} long" for c in ALL))
    grams = work.keep(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ALL]), "grams")
    learned = learned_ratios(grams, work)
    part, whole = (spark.sparkContext.broadcast(learned[x]) for x in ("fit", "all"))
    sums = ", ".join(f"{c} double" for c in SUMS)
    tried = source.join(F.broadcast(learn.where(fold == 4)), "doc_id").select("doc_id", "y", "text").mapInArrow(
        _score_task(part, ["doc_id", "y"]), "doc_id long, y int, " + sums).groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in ["y", *SUMS]]).toPandas()  # max_labels rows at most
    y = (tried["y"].to_numpy() > 0).astype(float)
    if len(set(y)) == 2:
        w = fit_logistic(features(tried[SUMS].to_numpy().T), y)
    else:
        share = learn.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0] or 0.0
        w = np.array([0.0, 0, 0, 0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))])

    def judge(rows: DataFrame, column: str, keep: list[str], names: list[str]) -> DataFrame:
        *sums, out = names
        schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in sums])
        n = F.greatest(F.col(sums[2]), F.lit(1.0))
        terms = [F.log(F.col(sums[3]) / n + 0.005), F.log(F.col(sums[4]) / n + 0.005), F.log(n + 1),
                 F.col(sums[0]) / F.greatest(F.col(sums[1]), F.lit(1.0)), F.lit(1.0)]
        line = sum((t * float(x) for t, x in zip(terms, w)), F.lit(0.0))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
        return rows.mapInArrow(_score_task(whole, keep, column, sums), schema).withColumn(out, score)

    return judge
