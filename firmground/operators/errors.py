"""Where a model is wrong: slices, residual bias, worst rows and fairness gaps."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from firmground.functions.columns import as_double, is_null, is_numeric
from firmground.functions.ordering import quantiles
from firmground.functions.stats import normal_p, student_p, two_proportion_z, welch


def differs(df: DataFrame, y: str, pred: str) -> Column:
    """1 where truth and prediction differ: as numbers when both are numeric, else as text."""
    both = is_numeric(df, y) and is_numeric(df, pred)
    kind = "double" if both else "string"
    return (~F.col(y).cast(kind).eqNullSafe(F.col(pred).cast(kind))).cast("int")


def is_classes(df: DataFrame, y: str, most: int = 20) -> bool:
    return df.select(y).where(~is_null(df, y)).distinct().limit(most + 1).count() <= most


def _errors(df: DataFrame, y: str, pred: str, metric: str) -> tuple[DataFrame, str]:
    if metric == "auto":
        metric = "error_rate" if is_classes(df, y) else "mae"
    err = differs(df, y, pred).cast("double") if metric == "error_rate" else F.abs(as_double(df, y) - as_double(df, pred))
    return df.withColumn("_e", err), metric


def overall_error(df: DataFrame, y: str, pred: str, metric: str = "auto") -> DataFrame:
    """``metric, value, n``: mismatch rate for classes, mean absolute error for numbers."""
    rows, metric = _errors(df, y, pred, metric)
    return rows.agg(F.avg("_e").alias("value"), F.count(F.lit(1)).alias("n")).select(
        F.lit(metric).alias("metric"), "value", "n")


def slice_errors(df: DataFrame, y: str, pred: str, cols: list[str], metric: str = "auto", min_n: int = 30,
                 alpha: float = 0.05) -> DataFrame:
    """``column, value, n, rate, rest_rate, stat, df, p, flag`` of every slice with at least ``min_n`` rows.

    Each slice is tested against all other rows (rows without a value in the slice column included): pooled
    two-proportion z for classes, Welch's t on absolute errors for numbers. One pass over the table; the rest is the
    total minus the slice. ``flag`` marks slices significantly worse than the rest.
    """
    rows, metric = _errors(df, y, pred, metric)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols])).alias("c")
    # count, mean and spread around it, which Spark merges pairwise: a small spread around a large error is not lost
    sums = [F.count("_e").alias("n"), F.avg("_e").alias("m"), (F.var_pop("_e") * F.count("_e")).alias("q")]
    part = rows.select("_e", cells).where("c.value is not null").groupBy("c.column", "c.value").agg(*sums)
    total = rows.agg(F.struct(*sums)).scalar()
    full = part.where(F.col("n") >= min_n).withColumn("_t", total)
    n, rate, q = F.col("n"), F.col("m"), F.col("q")
    rn = F.col("_t.n") - n
    rest = F.try_divide(F.col("_t.m") * F.col("_t.n") - rate * n, rn)
    rq = F.greatest(F.col("_t.q") - q - (rate - rest) * (rate - rest) * n * rn / F.col("_t.n"), F.lit(0.0))
    if metric == "error_rate":
        stat, dof = two_proportion_z(rate, n, rest, rn), F.lit(None).cast("double")
    else:
        stat, dof = welch(rate, F.try_divide(q, n - 1), n, rest, F.try_divide(rq, rn - 1), rn)
    table = full.select("column", "value", "n", rate.alias("rate"), rest.alias("rest_rate"), stat.alias("stat"),
                        dof.alias("df"))
    p = normal_p("stat") if metric == "error_rate" else student_p("stat", "df")
    return table.withColumn("p", p).withColumn("flag", F.coalesce(
        (F.col("rate") > F.col("rest_rate")) & (F.col("p") < alpha), F.lit(False)))


def flagged_slices(slices: DataFrame, top: int = 10) -> DataFrame:
    return slices.where("flag").orderBy("p", "column", "value").limit(top)


def residual_bias(df: DataFrame, y: str, pred: str, by: str) -> DataFrame:
    """``slice, n, bias, over_share``: mean of prediction minus truth, and the share predicted too high."""
    gap = F.col(pred) - F.col(y)
    return df.groupBy(F.col(by).alias("slice")).agg(
        F.count(gap).alias("n"), F.avg(gap).alias("bias"), F.avg((gap > 0).cast("int")).alias("over_share"))


def worst_rows(df: DataFrame, y: str, pred: str, key: list[str], inputs: list[str], k: int = 50) -> DataFrame:
    """The k rows with the largest absolute error, with the number of null and of out-of-range inputs on each.

    Out of range means beyond three interquartile ranges of that input over the whole table.
    """
    marks = {r["column"]: (r["q0"], r["q1"]) for r in quantiles(df, inputs, [0.25, 0.75]).collect()}
    nulls, outside = F.lit(0), F.lit(0)
    for c in inputs:
        nulls = nulls + is_null(df, c).cast("int")
        if c in marks and marks[c][1] > marks[c][0]:
            lo, hi = marks[c]
            away = ~as_double(df, c).between(lo - 3 * (hi - lo), hi + 3 * (hi - lo))
            outside = outside + F.coalesce(away, F.lit(False)).cast("int")
    err = F.abs(F.col(y) - F.col(pred))
    return df.select(*key, y, pred, err.alias("error"), nulls.alias("null_inputs"), outside.alias("range_flags")).where(
        "error is not null").orderBy(F.desc("error"), *key).limit(k)


def fairness(df: DataFrame, y: str, pred: str, attr: str) -> DataFrame:
    """Per group: ``n, error_rate, fpr, fnr, selection_rate`` and the gap of each to the best group.

    Best is the lowest error, false positive and false negative rate, and the highest selection rate.
    """
    wrong, sel, pos = (F.col(y) != F.col(pred)), F.col(pred) == 1, F.col(y) == 1
    table = df.where(F.col(attr).isNotNull()).groupBy(F.col(attr).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(wrong.cast("int")).alias("error_rate"),
        F.try_divide(F.count_if(sel & ~pos), F.count_if(~pos)).alias("fpr"),
        F.try_divide(F.count_if(~sel & pos), F.count_if(pos)).alias("fnr"),
        F.avg(sel.cast("int")).alias("selection_rate"))
    best = table.agg(F.struct(F.min("error_rate").alias("e"), F.min("fpr").alias("f"), F.min("fnr").alias("m"),
                              F.max("selection_rate").alias("s"))).scalar()
    return table.withColumn("_b", best).select(
        "grp", "n", "error_rate", "fpr", "fnr", "selection_rate", (F.col("error_rate") - F.col("_b.e")).alias("error_gap"),
        (F.col("fpr") - F.col("_b.f")).alias("fpr_gap"), (F.col("fnr") - F.col("_b.m")).alias("fnr_gap"),
        (F.col("_b.s") - F.col("selection_rate")).alias("selection_gap"))
