"""Boosted trees on counted cells: a tree only sees the bin of each feature, so rows alike in all bins and in the label are
one row with a weight.

Every row counts, once: the trees are those of Spark's own rule for split candidates (at most ``BINS`` bins a feature), with
the candidates taken from all rows and not from a sample of them. However many rows a table has, the trees are grown over
its cells, which the bins bound.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from firmground.functions.columns import join_by
from firmground.functions.ordering import CHUNK, parallelism, running, value_counts
from firmground.sources.scratch import stored

BINS = 32
#: A column with more values than this gives its cuts from groups of neighbouring values with about this share of the rows each.
FINE = 1024
#: Cells a task of a fit holds at least, where there are that many.
SHARE = 20_000


def split_points(groups: list[tuple[float, float, int]], bins: int = BINS) -> list[float]:
    """Spark's rule for a continuous feature: between all values if they are few, else where the running count is nearest to
    the next multiple of an even share. ``groups`` are ``(lowest, highest, rows)`` of neighbouring values in order."""
    between = [(a[1] + b[0]) / 2 for a, b in zip(groups, groups[1:])]
    if len(between) < bins:
        return between
    share = sum(n for *_, n in groups) / bins
    seen, target, out = groups[0][2], share, []
    for at, (*_, n) in zip(between, groups[1:]):
        before, seen = seen, seen + n
        if abs(before - target) < abs(seen - target):
            out.append(at)
            target += share
    return out


def cut_points(df: DataFrame, cols: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Split candidates of every column from the counts of all its values; the driver sees at most ``FINE`` groups a column."""
    counts = stored(value_counts(df, cols), "value-counts")
    totals = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_values"), F.sum("n").alias("_rows"))
    ranked = join_by(running(counts, ["value"], {"_upto": ("sum", "n")}, ["column"], chunk_col=CHUNK), totals, ["column"])
    place = F.floor((F.col("_upto") - F.col("n")) * F.lit(float(FINE)) / F.col("_rows")).cast("double")
    groups = ranked.groupBy("column", F.when(F.col("_values") > FINE, place).otherwise(F.col("value")).alias("_group")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n"))
    out: dict[str, list] = {c: [] for c in cols}
    for r in groups.collect():
        out[r["column"]].append((r["lo"], r["hi"], r["n"]))
    return {c: split_points(sorted(g), bins) for c, g in out.items()}


def bin_of(col: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value, as a double; a null stays null and fails the fit as it would without bins."""
    found = F.when(F.col(col).isNotNull(), F.lit(0))
    for c in cuts:
        found = found + (F.col(col) > F.lit(c)).cast("int")
    return found.cast("double")


class Boosted:
    """Gradient-boosted trees over the cells of a frame: bins once, then any number of fits on parts of it."""

    def __init__(self, df: DataFrame, features: list[str], y: str, task: str = "classification", by: list[str] | None = None):
        self.features, self.task, self.by = features, task, by or []
        self.cuts = cut_points(df, features)
        named = df.select(*self.by, F.col(y).cast("double").alias("_label"), *self._bins())
        keys = [*self.by, *[f"_b{i}" for i in range(len(features))]]
        one = F.count(F.lit(1)).cast("double").alias("_weight")
        if task == "classification":
            counted = named.groupBy(*keys, "_label").agg(one)
        else:  # the squared error around a cell's mean is the same under every tree
            counted = named.groupBy(*keys).agg(F.avg("_label").alias("_label"), one)
        self.cells = stored(counted, "cells")
        self.parts = min(parallelism(df.sparkSession), self.cells.count() // SHARE + 1)

    def _bins(self) -> list[Column]:
        return [bin_of(c, self.cuts[c]).alias(f"_b{i}") for i, c in enumerate(self.features)]

    def _vectors(self, df: DataFrame) -> DataFrame:
        names = [f"_b{i}" for i in range(len(self.features))]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df)

    def fit(self, trees: int, seed: int, depth: int = 3, part: Column | None = None):
        data = self.cells if part is None else self.cells.where(part)
        cls = GBTClassifier if self.task == "classification" else GBTRegressor
        return cls(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=trees, maxDepth=depth, maxBins=BINS,
                   stepSize=0.1, seed=seed).fit(self._vectors(data).select("_features", "_label", "_weight").coalesce(self.parts))

    def score(self, model, df: DataFrame, y: str, counted: bool = False) -> DataFrame:
        """``_label`` and what the model adds to each row of ``df``; with ``counted``, rows alike in bins and label are one row,
        their number its ``_weight``."""
        named = df.select(F.col(y).cast("double").alias("_label"), *self._bins())
        if counted:
            named = stored(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("_weight")), "scored-cells")
        return model.transform(self._vectors(named))
