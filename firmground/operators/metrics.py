"""Ranking, probability and error metrics over a prediction table, overall or per segment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from firmground.functions.columns import join_by
from firmground.functions.ordering import CHUNK, chunk_bounds, running, value_counts


def score_counts(df: DataFrame, y: str, p: str, by: list[str] | None = None,
                 cuts: list[list[float]] | None = None, weight: str | None = None) -> DataFrame:
    """Collapse a prediction table to one row per distinct score: ``by…, score, pos, neg``. ``weight``: how many rows a row is."""
    clean = df.where(F.col(y).isNotNull())
    many = F.col(weight) if weight else F.lit(1)
    counts = value_counts(clean, [p], by, {"pos": (F.col(y) == 1).cast("int") * many, "neg": (F.col(y) == 0).cast("int") * many}, cuts)
    return counts.withColumnRenamed("value", "score").drop("column")


def with_totals(df: DataFrame, source: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Attach group totals ``{out: column}`` of ``source``; without groups they arrive as scalar subqueries."""
    if by:
        return join_by(df, source.groupBy(*by).agg(*[F.sum(c).alias(o) for o, c in sums.items()]), by)
    return df.select("*", *[source.agg(F.sum(c)).scalar().alias(o) for o, c in sums.items()])


def ranking(df: DataFrame, y: str, p: str, by: list[str] | None = None,
            cuts: list[list[float]] | None = None, weight: str | None = None) -> DataFrame:
    """``by…, n, pos, auc, ap``: ROC AUC with half credit for ties, and average precision.

    NULL where a class is missing.
    """
    by = by or []
    seen = running(score_counts(df, y, p, by, cuts, weight), ["score"], {"tp": ("sum", "pos"), "fp": ("sum", "neg")}, by,
                   descending=True, chunk_col=CHUNK)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    return (
        seen.groupBy(*by).agg(
            F.sum(F.col("pos") + F.col("neg")).alias("n"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("_neg"),
            F.sum(neg * (tp - pos / 2)).alias("_pairs"),
            F.sum(F.try_divide(pos * tp, tp + fp)).alias("_area"),
        ).select(
            *by, "n", "pos",
            F.try_divide("_pairs", F.col("pos").cast("double") * F.col("_neg")).alias("auc"),
            F.when((F.col("pos") > 0) & (F.col("_neg") > 0), F.col("_area") / F.col("pos")).alias("ap"),
        )
    )


def auc(df: DataFrame, y: str, p: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    return ranking(df, y, p, by, weight=weight).select(*(by or []), F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"), "n")


def average_precision(df: DataFrame, y: str, p: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    return ranking(df, y, p, by, weight=weight).select(
        *(by or []), F.lit("average_precision").alias("metric"), F.col("ap").alias("value"), "n")


def ks_gini(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """``by…, ks, gini``: largest gap of the class distributions, and 2 AUC - 1."""
    by = by or []
    counts = score_counts(df, y, p, by)
    seen = running(counts, ["score"], {"pos_upto": ("sum", "pos"), "neg_upto": ("sum", "neg")}, by, chunk_col=CHUNK)
    full = with_totals(seen, counts, by, {"_p": "pos", "_n": "neg"})
    gap = F.abs(F.try_divide("pos_upto", "_p") - F.try_divide("neg_upto", "_n"))
    below = F.col("neg_upto") - F.col("neg") / 2
    return full.groupBy(*by).agg(
        F.max(gap).alias("ks"),
        F.sum(F.try_divide(F.col("pos") * below, F.col("_p").cast("double") * F.col("_n"))).alias("_auc"),
    ).select(*by, "ks", (2 * F.col("_auc") - 1).alias("gini"))


def column_auc(df: DataFrame, y: str, cols: list[str]) -> DataFrame:
    """ROC AUC of each numeric column as a predictor on its own: ``column, auc``."""
    counts = value_counts(df.where(F.col(y).isNotNull()), cols, None,
                          {"pos": (F.col(y) == 1).cast("int"), "neg": (F.col(y) == 0).cast("int")})
    seen = running(counts, ["value"], {"below": ("sum", "neg")}, ["column"], inclusive=False, chunk_col=CHUNK)
    pairs = F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("neg") / 2)
    return seen.groupBy("column").agg(
        F.try_divide(F.sum(pairs), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def _one(df: DataFrame, by: list[str] | None, name: str, value: Column) -> DataFrame:
    by = by or []
    return df.groupBy(*by).agg(value.alias("value"), F.count(F.lit(1)).alias("n")).select(
        *by, F.lit(name).alias("metric"), "value", "n")


def f1(df: DataFrame, y: str, p: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """F1 of ``p > threshold``; 0 where nothing is positive on either side."""
    flag, truth = F.col(p) > threshold, F.col(y) == 1
    tp, fp, fn = F.count_if(flag & truth), F.count_if(flag & ~truth), F.count_if(~flag & truth)
    return _one(df, by, "f1", F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))


def accuracy(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Share of rows whose prediction, rounded half to even, equals the truth."""
    return _one(df, by, "accuracy", F.avg((F.col(y) == F.bround(F.col(p), 0)).cast("int")))


def precision_recall(df: DataFrame, y: str, p: str, threshold: float = 0.5,
                     by: list[str] | None = None) -> DataFrame:
    """``by…, precision, recall, flagged`` at ``p >= threshold``."""
    flag, truth = F.col(p) >= threshold, F.col(y) == 1
    tp = F.count_if(flag & truth)
    return df.groupBy(*(by or [])).agg(
        F.try_divide(tp, F.count_if(flag)).alias("precision"),
        F.try_divide(tp, F.count_if(truth)).alias("recall"),
        F.count_if(flag).alias("flagged"),
    )


def precision_at_k(df: DataFrame, y: str, p: str, key: list[str], k: int) -> DataFrame:
    """Share of positives among the k highest scores (ties by key)."""
    top = df.orderBy(F.desc(p), *key).limit(k)
    return top.agg(F.avg((F.col(y) == 1).cast("int")).alias("value"), F.count(F.lit(1)).alias("n")).select(
        F.lit(f"precision_at_{k}").alias("metric"), "value", "n")


def neg_mae(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return _one(df, by, "neg_mae", -F.avg(F.abs(F.col(y) - F.col(p))))


def neg_rmse(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return _one(df, by, "neg_rmse", -F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2))))


def brier(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return _one(df, by, "brier", F.avg(F.pow(F.col(p) - F.col(y), 2)))


def fold_stats(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """``by…, folds, mean, se`` of per-fold scores; the standard error is NULL under two folds."""
    return df.groupBy(*by).agg(
        F.count(score).alias("folds"),
        F.avg(score).alias("mean"),
        F.when(F.count(score) >= 2, F.stddev_samp(score) / F.sqrt(F.count(score))).alias("se"),
    )


def by_segment(df: DataFrame, y: str, p: str, segment: str, drop: float = 0.05, min_n: int = 30) -> DataFrame:
    """Ranking metrics per segment beside the overall AUC; ``collapsed`` where the AUC falls by more than ``drop``."""
    cuts = chunk_bounds(df, [p])
    overall = ranking(df, y, p, cuts=cuts).select("auc")
    error = df.groupBy(segment).agg(F.avg((F.col(y) != F.bround(F.col(p), 0)).cast("int")).alias("error_rate"))
    return (
        join_by(ranking(df, y, p, [segment], cuts), error, [segment])
        .withColumn("overall_auc", overall.scalar())
        .withColumn("collapsed", (F.col("n") >= min_n) & (F.col("auc") < F.col("overall_auc") - drop))
    )
