"""Bootstrap intervals without a copy of the table per replicate, and without one task seeing all scores.

Rows are collapsed to weighted cells first. Cells are cut into chunks of bounded size along the score order; each task
draws the weights of one chunk for one batch of replicates and returns a few numbers per replicate. Nothing depends on
partition counts: chunks follow exact ranks, and random numbers are keyed by seed and position in the data.

* One score, stratified: multinomial counts per class, exactly as resampling rows. A task finds its chunk's share of
  each replicate by walking a binary tree of binomial splits whose draws are keyed by tree node, so all tasks agree. The
  totals along its path are joined to it; nobody sees those of all chunks.
* Two scores on the same rows: Poisson(1) weights per row, keyed by cell, so that both orders see the same resample.
"""
from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from firmground.functions.columns import attach, linear_bucket
from firmground.functions.ordering import CHUNK, chunk_bounds, running, with_chunk
from firmground.operators import metrics as M
from firmground.sources.scratch import stored

# Task functions of this module travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 20_000
BATCH = 250


def _rng(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([p & 0xFFFFFFFFFFFFFFFF for p in parts])))


def chunk_draws(whole: np.ndarray, left: np.ndarray, chunk: int, reps: int, key: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate: draws falling below the chunk and inside it, out of a multinomial over all chunks.

    ``whole`` and ``left`` are the totals of the tree's nodes above the chunk, from the root, and of their left halves.
    """
    depth, node = len(whole) - 1, 1
    inside = np.full(reps, whole[0], dtype=np.int64)
    below = np.zeros(reps, dtype=np.int64)
    for level in range(depth):
        low = _rng(*key, node).binomial(inside, left[level] / whole[level] if whole[level] else 0.0)
        if chunk >> (depth - 1 - level) & 1:
            below, inside, node = below + low, inside - low, 2 * node + 1
        else:
            inside, node = low, 2 * node
    return below, inside


def tree_paths(chunks: DataFrame, last: int, sums: list[str]) -> DataFrame:
    """``chunk, {sum}_whole, {sum}_left``: for each chunk 0..last, the totals of the nodes above it in a binary tree over the
    chunks, and of their left halves; as many numbers as the tree has levels, not one per chunk."""
    depth = max(last, 0).bit_length()
    levels = F.sequence(F.lit(0), F.lit(depth))
    node = lambda level: F.expr(f"shiftright(chunk, {depth} - {level})")
    spread = chunks.withColumn("_level", F.explode(levels)).withColumn("_node", node("_level"))
    totals = spread.groupBy("_level", "_node").agg(*[F.sum(c).alias(c) for c in sums])
    half = totals.where("_level > 0 and _node % 2 = 0").select(
        (F.col("_level") - 1).alias("_level"), F.shiftright("_node", 1).alias("_node"), *[F.col(c).alias(f"_left_{c}") for c in sums])
    nodes = totals.join(half, ["_level", "_node"], "left")
    path = F.sort_array(F.collect_list(F.struct("_level", *sums, *[F.coalesce(f"_left_{c}", F.lit(0)).alias(f"_left_{c}") for c in sums])))
    found = spread.select("chunk", "_level", "_node").join(nodes, ["_level", "_node"]).groupBy("chunk").agg(path.alias("p"))
    return found.select("chunk", *[F.col(f"p.{k}{c}").alias(f"{c}_{n}") for c in sums for k, n in (("", "whole"), ("_left_", "left"))])


def _multinomial(weights: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    total = weights.sum()
    if total == 0:
        return np.zeros((len(n), len(weights)), dtype=np.int64)
    return rng.multinomial(n, weights / total)


def _stratified_task(metric: str, pos_all: float, neg_all: float, n_boot: int, seed: int, threshold: float):
    def run(key: tuple, cells: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        chunk, batch = int(key[0]), int(key[1])
        first = batch * BATCH
        reps = min(BATCH, n_boot - first)
        cells = cells.sort_values("score")
        path = paths.iloc[0]
        p_below, p_in = chunk_draws(path["pos_whole"], path["pos_left"], chunk, reps, (seed, 1, batch))
        n_below, n_in = chunk_draws(path["neg_whole"], path["neg_left"], chunk, reps, (seed, 0, batch))
        pos = _multinomial(cells["pos"].to_numpy(dtype=float), p_in, _rng(seed, 3, batch, chunk))
        neg = _multinomial(cells["neg"].to_numpy(dtype=float), n_in, _rng(seed, 2, batch, chunk))
        b = np.zeros(reps)
        if metric == "roc_auc":
            below = n_below[:, None] + np.cumsum(neg, axis=1) - neg
            a = (pos * (below + neg / 2.0)).sum(axis=1) / (pos_all * neg_all)
        elif metric == "average_precision":
            tp = pos_all - p_below[:, None] - np.cumsum(pos, axis=1) + pos
            fp = neg_all - n_below[:, None] - np.cumsum(neg, axis=1) + neg
            a = (pos * tp / np.maximum(tp + fp, 1.0)).sum(axis=1) / pos_all
        else:
            on = cells["score"].to_numpy() > threshold
            a, b = pos[:, on].sum(axis=1).astype(float), neg[:, on].sum(axis=1).astype(float)
        return pd.DataFrame({"rep": np.arange(first, first + reps), "a": a, "b": b})

    return run


def point_value(df: DataFrame, y: str, p: str, metric: str) -> DataFrame:
    table = {"roc_auc": M.auc, "average_precision": M.average_precision, "f1": M.f1, "accuracy": M.accuracy,
             "mae": M.neg_mae, "rmse": M.neg_rmse}
    return table[metric](df, y, p).select(F.col("value").alias("point"))


def replicates(df: DataFrame, y: str, p: str, metric: str, n_boot: int = 2000, seed: int = 42,
               threshold: float = 0.5) -> tuple[DataFrame | None, int, int]:
    """``rep, value`` of each stratified replicate (None when a class is missing), and the class sizes."""
    cells = M.score_counts(df, y, p)
    ranked = running(cells.withColumn("_one", F.lit(1)), ["score"], {"_i": ("sum", "_one")}, chunk_col=CHUNK)
    placed = ranked.select(linear_bucket(F.col("_i") - 1, CELLS).alias("chunk"), "score", "pos", "neg")
    placed = stored(placed, "score-chunks")
    sums = placed.groupBy("chunk").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n_pos, n_neg, last = (x or 0 for x in sums.agg(F.sum("pos"), F.sum("neg"), F.max("chunk")).first())
    if n_pos == 0 or n_neg == 0:
        return None, n_pos, n_neg
    batches = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BATCH)))
    paths = tree_paths(sums, last, ["pos", "neg"]).withColumnRenamed("chunk", "_of").withColumn("_of", F.col("_of") + 0).withColumn("_batch", batches)
    parts = placed.withColumn("batch", batches).groupBy("chunk", "batch").cogroup(paths.groupBy("_of", "_batch")).applyInPandas(
        _stratified_task(metric, float(n_pos), float(n_neg), n_boot, seed, threshold), "rep int, a double, b double")
    a, b = F.sum("a"), F.sum("b")
    value = a if metric != "f1" else F.coalesce(F.try_divide(2 * a, a + b + F.lit(float(n_pos))), F.lit(0.0))
    return parts.groupBy("rep").agg(value.alias("value")), n_pos, n_neg


def bootstrap_ci(df: DataFrame, y: str, p: str, metric: str = "average_precision", n_boot: int = 2000, ci: float = 0.9,
                 seed: int = 42) -> DataFrame:
    """``metric, point, lower, upper, width, ci, n_boot, n_pos, n`` of a stratified bootstrap.

    The interval is NULL when a class is missing or under half of the replicates have a value.
    """
    reps, n_pos, n_neg = replicates(df, y, p, metric, n_boot, seed)
    point = point_value(df, y, p, metric)
    tail = (1 - ci) / 2
    if reps is None:
        row = point.select("point", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
                           F.lit(0).cast("bigint").alias("n_boot"))
    else:
        ok = F.count("value") >= 0.5 * n_boot
        span = reps.agg(F.when(ok, F.percentile("value", F.lit(tail))).alias("lower"),
                        F.when(ok, F.percentile("value", F.lit(1 - tail))).alias("upper"), F.count("value").alias("n_boot"))
        row = attach(point, span)
    return row.select(F.lit(metric).alias("metric"), "point", "lower", "upper", (F.col("upper") - F.col("lower")).alias("width"),
                      F.lit(ci).alias("ci"), "n_boot", F.lit(n_pos).cast("bigint").alias("n_pos"),
                      F.lit(n_pos + n_neg).cast("bigint").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser on unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """The first count with any weight, and the distribution function from there on."""
    reach = 12 * math.sqrt(mean) + 20
    low = max(0, int(mean - reach))
    k = np.arange(low + 1, int(mean + reach) + 1)
    logs = np.concatenate([[low * math.log(mean) - mean - math.lgamma(low + 1)], np.log(mean / k)]).cumsum()
    return low, np.exp(logs).cumsum()


def poisson_weights(keys: np.ndarray, copies: np.ndarray, first: int, reps: int, seed: int) -> np.ndarray:
    """Poisson(copies) weights, shape (reps, cells), a function of seed, cell key and replicate only.

    Every weight is the inverse distribution function at one hashed uniform number, whatever the number of copies.
    """
    out = np.zeros((reps, len(keys)), dtype=np.int64)
    with np.errstate(over="ignore"):
        lanes = _mix(np.arange(first, first + reps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        salted = _mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0xD1B54A32D192ED03))
        for n in np.unique(copies):
            if n <= 0:
                continue
            low, cdf = _poisson_table(int(n))
            use = np.flatnonzero(copies == n)
            u = (_mix(lanes[:, None] ^ salted[use][None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            out[:, use] = low + np.searchsorted(cdf, u, side="right")
    return out


def _score_sums(cells: pd.DataFrame, first: int, reps: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ascending scores with resampled positives and negatives, shape (reps, scores)."""
    cells = cells.sort_values("score")
    w = poisson_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(), first, reps, seed)
    score, y = cells["score"].to_numpy(), cells["y"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    pos, neg = np.add.reduceat(w * (y == 1), starts, axis=1), np.add.reduceat(w * (y == 0), starts, axis=1)
    return score[starts], pos, neg


def _totals_task(n_boot: int, seed: int, threshold: float):
    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        side, chunk, batch, _sub = key
        first = int(batch) * BATCH
        reps = min(BATCH, n_boot - first)
        score, pos, neg = _score_sums(cells, first, reps, seed)
        below = np.cumsum(neg, axis=1) - neg
        on = score > threshold
        return pd.DataFrame({
            "side": side, "chunk": chunk, "batch": batch, "rep": np.arange(first, first + reps),
            "pos": pos.sum(axis=1).astype(float), "neg": neg.sum(axis=1).astype(float),
            "inner": (pos * (below + neg / 2.0)).sum(axis=1).astype(float),
            "tp": pos[:, on].sum(axis=1).astype(float), "fp": neg[:, on].sum(axis=1).astype(float)})

    return run


def _area_task(n_boot: int, seed: int):
    def run(cells: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        above = above.sort_values("rep")
        first, reps = int(above["rep"].iloc[0]), len(above)
        _, pos, neg = _score_sums(cells, first, reps, seed)
        tp = above["pos_above"].to_numpy()[:, None] + np.cumsum(pos[:, ::-1], axis=1)[:, ::-1]
        fp = above["neg_above"].to_numpy()[:, None] + np.cumsum(neg[:, ::-1], axis=1)[:, ::-1]
        area = (pos * tp / np.maximum(tp + fp, 1.0)).sum(axis=1)
        return pd.DataFrame({"side": above["side"].to_numpy(), "rep": above["rep"].to_numpy(), "area": area})

    return run


def _in_order(cells: DataFrame, score: str, side: str) -> DataFrame:
    """Cells with the chunk of their score along one order; a score with very many cells gets parts of its own."""
    per = cells.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("k"))
    upto = running(per, ["score"], {"upto": ("sum", "k")})
    at = linear_bucket(F.col("upto") - F.col("k"), CELLS)
    hot = F.col("k") > CELLS
    spots = upto.select("score", (2 * at + hot.cast("int")).alias("chunk"), hot.alias("hot"),
                        F.when(hot, F.ceil(F.col("k") / CELLS)).otherwise(1).cast("bigint").alias("parts"))
    return cells.withColumn("score", F.col(score)).join(spots, "score").select(
        F.lit(side).alias("side"), "chunk", "hot", F.pmod("cell", "parts").alias("sub"), "score", "y", "n", "cell")


def paired_replicates(df: DataFrame, y: str, a: str, b: str, metric: str, n_boot: int, seed: int,
                      threshold: float = 0.5) -> DataFrame:
    """``rep, diff``: metric of score a minus that of score b on the same resampled rows."""
    known = df.where(F.col(y).isin(0, 1) & F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(F.col(y).cast("int").alias("y"), F.col(a).cast("double").alias("a"),
                          F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "cell", F.xxhash64("y", "a", "b"))
    both = _in_order(cells, "a", "a").unionByName(_in_order(cells, "b", "b"))
    work = both.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BATCH))))
    raw = work.groupBy("side", "chunk", "batch", "sub").applyInPandas(
        _totals_task(n_boot, seed, threshold),
        "side string, chunk bigint, batch int, rep int, pos double, neg double, inner double, tp double, fp double")
    merged = raw.groupBy("side", "chunk", "batch", "rep").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "inner", "tp", "fp")])
    single = F.pmod("chunk", F.lit(2)) == 1
    merged = merged.withColumn("inner", F.when(single, F.col("pos") * F.col("neg") / 2).otherwise(F.col("inner")))
    if metric == "roc_auc":
        w = Window.partitionBy("side", "rep").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        pairs = merged.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0)))
        side = pairs.groupBy("side", "rep").agg(F.try_divide(
            F.sum(F.col("inner") + F.col("pos") * F.col("below")), F.sum("pos") * F.sum("neg")).alias("v"))
    elif metric == "f1":
        side = merged.groupBy("side", "rep").agg(F.coalesce(F.try_divide(
            2 * F.sum("tp"), F.sum("tp") + F.sum("fp") + F.sum("pos")), F.lit(0.0)).alias("v"))
    else:
        w = Window.partitionBy("side", "rep").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = merged.select("side", "chunk", "batch", "rep", "pos", "neg",
                                F.coalesce(F.sum("pos").over(w), F.lit(0.0)).alias("pos_above"),
                                F.coalesce(F.sum("neg").over(w), F.lit(0.0)).alias("neg_above"))
        plain = work.where("not hot").groupBy("side", "chunk", "batch").cogroup(
            offsets.where(~single).groupBy("side", "chunk", "batch")).applyInPandas(
            _area_task(n_boot, seed), "side string, rep int, area double")
        tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
        lone = offsets.where(single).select("side", "rep", (F.col("pos") * tp / F.greatest(tp + fp, F.lit(1.0))).alias("area"))
        area = plain.unionByName(lone).groupBy("side", "rep").agg(F.sum("area").alias("area"))
        pos = merged.groupBy("side", "rep").agg(F.sum("pos").alias("pos"))
        side = area.join(pos, ["side", "rep"]).select("side", "rep", F.try_divide("area", "pos").alias("v"))
    return side.groupBy("rep").agg((F.max(F.when(F.col("side") == "a", F.col("v")))
                                    - F.max(F.when(F.col("side") == "b", F.col("v")))).alias("diff"))


def _additive_task(metric: str, n_boot: int, seed: int):
    def run(frames):
        total = np.zeros((n_boot, 3))
        for cells in frames:
            for start in range(0, len(cells), CELLS):
                part = cells.iloc[start:start + CELLS]
                y, a, b = (part[c].to_numpy(dtype=float) for c in ("y", "a", "b"))
                if metric == "accuracy":
                    va, vb = (y == np.round(a)).astype(float), (y == np.round(b)).astype(float)
                elif metric == "mae":
                    va, vb = -np.abs(y - a), -np.abs(y - b)
                else:
                    va, vb = (y - a) ** 2, (y - b) ** 2
                for first in range(0, n_boot, BATCH):
                    reps = min(BATCH, n_boot - first)
                    w = poisson_weights(part["cell"].to_numpy(), part["n"].to_numpy(), first, reps, seed)
                    total[first:first + reps] += np.stack([w.sum(axis=1), w @ va, w @ vb], axis=1)
        yield pd.DataFrame({"rep": np.arange(n_boot), "w": total[:, 0], "a": total[:, 1], "b": total[:, 2]})

    return run


def additive_replicates(df: DataFrame, y: str, a: str, b: str, metric: str, n_boot: int, seed: int) -> DataFrame:
    """``rep, diff`` for accuracy, mae or rmse: weighted sums per partition, then one small aggregation."""
    cells = df.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(y).cast("double").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("cell", F.xxhash64("y", "a", "b"))
    sums = cells.mapInPandas(_additive_task(metric, n_boot, seed), "rep int, w double, a double, b double").groupBy(
        "rep").agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    if metric == "rmse":
        return sums.select("rep", (F.sqrt(F.try_divide("b", "w")) - F.sqrt(F.try_divide("a", "w"))).alias("diff"))
    return sums.select("rep", F.try_divide(F.col("a") - F.col("b"), F.col("w")).alias("diff"))


def paired_bootstrap(df: DataFrame, y: str, model: str, baseline: str, metric: str = "average_precision",
                     n_boot: int = 2000, ci: float = 0.9, seed: int = 42) -> DataFrame:
    """``metric, score_a, score_b, delta, lower, upper, significant, verdict, n_boot`` of model minus baseline."""
    ranked = metric in ("roc_auc", "average_precision", "f1")
    reps = (paired_replicates if ranked else additive_replicates)(df, y, model, baseline, metric, n_boot, seed)
    tail = (1 - ci) / 2
    span = reps.agg(F.percentile("diff", F.lit(tail)).alias("lower"), F.percentile("diff", F.lit(1 - tail)).alias("upper"),
                    F.count("diff").alias("n_boot"))
    known = df.where(F.col(y).isNotNull() & F.col(model).isNotNull() & F.col(baseline).isNotNull())
    row = point_value(known, y, model, metric).select(F.col("point").alias("score_a"))
    row = attach(attach(row, point_value(known, y, baseline, metric).select(F.col("point").alias("score_b"))), span)
    delta = F.col("score_a") - F.col("score_b")
    sure = (F.col("lower") > 0) | (F.col("upper") < 0)
    verdict = F.when(sure & (delta > 0), "win").when(sure & (delta < 0), "loss").otherwise("no difference")
    return row.select(F.lit(metric).alias("metric"), "score_a", "score_b", delta.alias("delta"), "lower", "upper",
                      sure.alias("significant"), verdict.alias("verdict"), "n_boot")


def compare_rows(df: DataFrame, y: str, model: str, baseline: str) -> DataFrame:
    """``n, delta, wins, losses, ties``: mean gain in absolute error and the rows each side predicts better."""
    a, b = F.abs(F.col(y) - F.col(model)), F.abs(F.col(y) - F.col(baseline))
    return df.where(a.isNotNull() & b.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(b - a).alias("delta"), F.count_if(a < b).alias("wins"),
        F.count_if(a > b).alias("losses"), F.count_if(a == b).alias("ties"))


def adjust_pvalues(df: DataFrame, p: str, method: str = "bh", alpha: float = 0.05) -> DataFrame:
    """Input plus ``adjusted`` and ``reject``: Bonferroni, or the Benjamini-Hochberg step-up rule."""
    known = df.where(F.col(p).isNotNull())
    n = known.agg(F.count(F.lit(1))).scalar()
    if method == "bonferroni":
        out = df.withColumn("adjusted", F.least(F.col(p) * n, F.lit(1.0)))
    else:
        bounds = chunk_bounds(known, [p])[0]
        per = with_chunk(known.groupBy(p).agg(F.count(F.lit(1)).alias("k")), p, bounds)
        ranked = running(per, [p], {"upto": ("sum", "k")}, chunk_col=CHUNK).withColumn("q", F.col(p) * n / F.col("upto"))
        final = running(ranked, [p], {"adjusted": ("min", "q")}, descending=True, chunk_col=CHUNK)
        out = df.join(final.select(p, F.least("adjusted", F.lit(1.0)).alias("adjusted")), p, "left")
    return out.withColumn("reject", F.col("adjusted") <= alpha)
