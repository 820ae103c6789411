"""Reliability of predicted probabilities and their repair."""
from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from firmground.functions.coding import numbered
from firmground.functions.columns import attach
from firmground.functions.ordering import CHUNK, chunk_bounds, running, with_chunk
from firmground.operators.metrics import ranking, score_counts
from firmground.sources.scratch import stored

# Task functions of this module travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Verdict limits on the expected and the largest calibration error, and isotonic's need of positives.
LIMITS = ((0.02, 0.05, "well-calibrated"), (0.05, 0.10, "acceptable"), (0.10, None, "poor"))
MIN_POSITIVES = 200


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """``bin, center, predicted, observed, count`` over equal-width bins of [0, 1], left-closed, the last one closed."""
    edges = [i * (1 / bins) for i in range(bins)] + [1.0]
    inside = df.select(F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p")).where(
        F.col("_p").between(0.0, 1.0) & F.col("_y").isNotNull())
    binned = Bucketizer(splits=edges, inputCol="_p", outputCol="_bin").transform(inside)
    at = F.col("_bin").cast("int")
    table = binned.groupBy(at.alias("bin")).agg(
        F.avg("_p").alias("predicted"), F.avg("_y").alias("observed"), F.count(F.lit(1)).alias("count"))
    lit_edges = F.array(*[F.lit(e) for e in edges])
    center = (F.get(lit_edges, F.col("bin")) + F.get(lit_edges, F.col("bin") + 1)) / 2
    return table.select("bin", center.alias("center"), "predicted", "observed", "count")


def calibration_summary(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """``ece, max_ce, brier, bins_used, verdict``."""
    gap = F.abs(F.col("observed") - F.col("predicted"))
    row = reliability(df, y, p, bins).agg(
        F.coalesce(F.try_divide(F.sum(F.col("count") * gap), F.sum("count")), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_ce"), F.count(F.lit(1)).alias("bins_used"))
    verdict = F.lit("severe")
    for ece, worst, word in reversed(LIMITS):
        ok = F.col("ece") < ece
        verdict = F.when(ok & (F.col("max_ce") < worst) if worst else ok, word).otherwise(verdict)
    brier = df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    return attach(row, brier).select("ece", "max_ce", "brier", "bins_used", verdict.alias("verdict"))


@dataclass
class Platt:
    """Sigmoid of a linear function of the score."""
    slope: float
    intercept: float

    def apply(self, df: DataFrame, p: str, out: str) -> DataFrame:
        return df.withColumn(out, 1 / (1 + F.exp(-(F.lit(self.slope) * F.col(p) + F.lit(self.intercept)))))


STEPS = "low double, high double, pos bigint, n bigint"


@dataclass
class Isotonic:
    """Monotone function of the score: ``steps`` of one value from ``low`` to ``high`` and lines between them, clamped at both
    ends. The steps are a table; a score finds its own by the running maximum of the lower ends."""
    steps: DataFrame

    def apply(self, df: DataFrame, p: str, out: str) -> DataFrame:
        score = (F.col(p).cast("double") + F.lit(0.0)).alias("_score")
        asked = df.select(score).where("_score is not null and not isnan(_score)").distinct()
        cuts = chunk_bounds(asked, ["_score"])[0]
        both = asked.select("_score", F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_low")).unionByName(
            self.steps.select(F.col("low").alias("_score"), F.lit(0).alias("_kind"), F.col("low").alias("_low")))
        placed = running(with_chunk(both, "_score", cuts), ["_score", "_kind"], {"_at": ("max", "_low")}, chunk_col=CHUNK).where("_kind = 1")
        first = self.steps.agg(F.min(F.struct("low", "value"))["value"].alias("_first"))
        x = F.col("_score")
        share = (x - F.col("high")) / (F.col("next_low") - F.col("high"))
        value = F.when(F.col("low").isNull(), F.col("_first")).when((x <= F.col("high")) | F.col("next_low").isNull(), F.col("value")).otherwise(
            F.col("value") + share * (F.col("next_value") - F.col("value")))
        told = attach(placed.join(self.steps, F.col("_at") == F.col("low"), "left"), first).select("_score", value.alias("_told"))
        joined = df.withColumn("_mine", score).join(told, F.col("_mine") == F.col("_score"), "left")
        return joined.select(*df.columns, F.col("_told").alias(out))


def platt_fit(df: DataFrame, y: str, p: str) -> Platt:
    """Logistic fit on smoothed targets, each distinct score entering as one weighted row per class."""
    counts = score_counts(df, y, p).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg = counts.agg(F.sum("pos"), F.sum("neg")).first()
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    yes = F.col("pos") * hi + F.col("neg") * lo
    no = F.col("pos") * (1 - hi) + F.col("neg") * (1 - lo)
    rows = counts.select("score", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), yes.alias("weight")),
        F.struct(F.lit(0.0).alias("label"), no.alias("weight")))).alias("r")).select("score", "r.*")
    data = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows)
    model = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=200, tol=1e-10).fit(data)
    return Platt(float(model.coefficients[0]), float(model.intercept))


def pool(pos: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Where blocks of never falling shares begin and end (the last member), by pooling adjacent violators."""
    out: list[list] = []  # first, last, positives, rows
    for i, (a, b) in enumerate(zip(pos.tolist(), n.tolist())):
        out.append([i, i, a, b])
        while len(out) > 1 and out[-2][2] * out[-1][3] > out[-1][2] * out[-2][3]:
            _, last, a, b = out.pop()
            out[-1][1:] = [last, out[-1][2] + a, out[-1][3] + b]
    return [(x[0], x[1]) for x in out]


def _pool_task(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low", ignore_index=True)
    first, last = (np.array(x) for x in zip(*pool(rows["pos"], rows["n"])))
    sums = {c: np.add.reduceat(rows[c].to_numpy(), first) for c in ("pos", "n")}
    return pd.DataFrame({"low": rows["low"].to_numpy()[first], "high": rows["high"].to_numpy()[last], **sums, "_chunk": rows["_chunk"].iloc[0]})


def isotonic_fit(df: DataFrame, y: str, p: str, size: int = 20_000) -> Isotonic:
    """Pool-adjacent-violators fit, refused when positives are too few to carry steps.

    Violators may be pooled in any order. Chunks of ``size`` neighbouring blocks are pooled by themselves; as long as values
    fall between two chunks, the blocks are numbered anew and pooled in chunks shifted by a half.
    """
    counts = score_counts(df, y, p).groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    positives = counts.agg(F.sum("pos")).first()[0] or 0
    if positives < MIN_POSITIVES:
        raise ValueError(f"isotonic calibration needs {MIN_POSITIVES} positives, found {positives}")
    blocks = counts.select(F.col("score").alias("low"), F.col("score").alias("high"), "pos", (F.col("pos") + F.col("neg")).alias("n"))
    turn = 0
    while True:
        placed = numbered(blocks, ["low"], "_i", "isotonic")
        chunk = F.floor((F.col("_i") + F.lit(turn % 2 * (size // 2))) / size)
        pooled = placed.withColumn("_chunk", chunk).groupBy("_chunk").applyInPandas(_pool_task, STEPS + ", _chunk bigint")
        blocks = stored(pooled, "isotonic-steps")
        value = F.col("pos") / F.col("n")
        ends = blocks.groupBy("_chunk").agg(F.min(F.struct("low", value.alias("v"))).alias("a"), F.max(F.struct("low", value.alias("v"))).alias("b")).orderBy("_chunk").collect()  # a row per chunk
        if all(x["b"]["v"] <= y["a"]["v"] for x, y in zip(ends, ends[1:])):
            break
        blocks, turn = blocks.drop("_chunk"), turn + 1
    follows = Window.partitionBy("_chunk").orderBy("low")
    starts = df.sparkSession.createDataFrame([(x["_chunk"], y["a"]["low"], y["a"]["v"]) for x, y in zip(ends, ends[1:])], "_chunk bigint, _low double, _value double")
    steps = blocks.withColumn("value", value).withColumns({"next_low": F.lead("low").over(follows), "next_value": F.lead("value").over(follows)})
    steps = steps.join(F.broadcast(starts), "_chunk", "left").select(
        "low", "high", "value", F.coalesce("next_low", "_low").alias("next_low"), F.coalesce("next_value", "_value").alias("next_value"))
    return Isotonic(stored(steps, "isotonic"))


def rank_check(df: DataFrame, y: str, before: str, after: str, tolerance: float = 0.01) -> DataFrame:
    """``ap_before, ap_after, delta, rank_kept, in_range``: calibration must keep the order and stay in [0, 1]."""
    row = ranking(df, y, before).select(F.col("ap").alias("ap_before"))
    row = attach(row, ranking(df, y, after).select(F.col("ap").alias("ap_after")))
    row = attach(row, df.agg(F.min(after).alias("_lo"), F.max(after).alias("_hi")))
    delta = F.col("ap_after") - F.col("ap_before")
    return row.select("ap_before", "ap_after", delta.alias("delta"), (delta >= -tolerance).alias("rank_kept"),
                      ((F.col("_lo") >= 0) & (F.col("_hi") <= 1)).alias("in_range"))
