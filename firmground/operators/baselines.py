"""Simple predictors a model has to beat, forecasts that need no model, and series checks."""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from firmground.functions.boosting import Boosted
from firmground.functions.coding import label_codes, with_codes
from firmground.functions.columns import as_double, is_null, is_numeric, micros, union_all
from firmground.functions.ordering import framed, quantiles
from firmground.operators import metrics as M
from firmground.operators.splits import numbered
from firmground.sources.scratch import stored

METRICS = {"roc_auc": M.auc, "average_precision": M.average_precision, "f1": M.f1, "neg_rmse": M.neg_rmse}


def encode(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numbers for every feature: text codes in alphabetical order of the train values (null is the value
    ``__missing__``, unseen text gets the next code), numeric nulls the train median."""
    num = [c for c in features if is_numeric(train, c)]
    text = [c for c in features if c not in num]
    marks = {r["column"]: r["q0"] for r in quantiles(train, num, [0.5]).collect()} if num else {}
    sides = []
    named = [df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) for c in text})
             for df in (train, test)]
    codes = label_codes(named[0], text) if text else None
    for df in named:
        if text:
            df = with_codes(df, codes, {c: f"_i_{c}" for c in text})
        df = df.withColumns({c: F.col(f"_i_{c}").cast("double") for c in text} | {
            c: F.coalesce(as_double(df, c), F.lit(marks.get(c)).cast("double")) for c in num})
        sides.append(df.drop(*[f"_i_{c}" for c in text]))
    return sides[0], sides[1]


def trivial(train: DataFrame, test: DataFrame, y: str, metric: str) -> DataFrame:
    """``score`` of always predicting the majority (or, for an error metric, the mean)."""
    if metric == "average_precision":
        return train.agg(F.avg(y).alias("score"))
    if metric == "neg_rmse":
        return test.agg((-F.stddev_pop(y)).alias("score"))
    return test.sparkSession.range(1).select(F.lit(0.5 if metric == "roc_auc" else 0.0).alias("score"))


def mean_predictor(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    guess = train.agg(F.avg(y)).scalar()
    return M.neg_rmse(test.withColumn("_guess", guess), y, "_guess").select(F.col("value").alias("score"))


def last_value(train: DataFrame, test: DataFrame, y: str, ts: str, key: str) -> DataFrame:
    """Every test row predicted by the target of the latest train row (ties to the larger key)."""
    guess = train.agg(F.max_by(y, F.struct(ts, key)).cast("double")).scalar()
    return M.neg_rmse(test.withColumn("_guess", guess), y, "_guess").select(F.col("value").alias("score"))


def _vectors(df: DataFrame, features: list[str], y: str) -> DataFrame:
    ready = df.withColumn("_label", F.col(y).cast("double"))
    return VectorAssembler(inputCols=features, outputCol="_features").transform(ready)


def _probability(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("_label", vector_to_array("probability")[1].alias("_p"))


def logistic(train: DataFrame, test: DataFrame, y: str, features: list[str], balanced: bool = False) -> DataFrame:
    """``_label, _p``: L2-penalised logistic regression, optionally with classes weighted to equal mass."""
    data = _vectors(train, features, y)
    n, pos = data.agg(F.count(F.lit(1)), F.sum("_label")).first()
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col("_label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_w", regParam=1.0 / n,
                             standardization=False, maxIter=1000).fit(data.withColumn("_w", weight))
    return _probability(fit, _vectors(test, features, y))


def boosted(train: DataFrame, test: DataFrame, y: str, features: list[str], task: str = "classification",
            trees: int = 100, seed: int = 0, counted: bool = False) -> DataFrame:
    """``_label, _p`` of gradient-boosted trees of depth 3; with ``counted``, a classifier's equal rows are one with a ``_weight``."""
    grown = Boosted(train, features, y, task)
    counted = counted and task == "classification"
    scored = grown.score(grown.fit(trees, seed), test, y, counted)
    if task == "classification":
        return scored.select("_label", vector_to_array("probability")[1].alias("_p"), *["_weight"] * counted)
    return scored.select("_label", F.col("prediction").alias("_p"))


def ridge(train: DataFrame, test: DataFrame, y: str, features: list[str], alpha: float = 1.0) -> DataFrame:
    """``_label, _p`` of linear regression with an L2 penalty."""
    data = _vectors(train, features, y)
    fit = LinearRegression(featuresCol="_features", labelCol="_label", regParam=alpha / data.count(), elasticNetParam=0.0,
                           standardization=False, solver="normal").fit(data)
    return fit.transform(_vectors(test, features, y)).select("_label", F.col("prediction").alias("_p"))


def rule(test: DataFrame, y: str, prediction: Column, metric: str) -> DataFrame:
    """``score`` of a stated rule used as the predictor."""
    return METRICS[metric](test.withColumn("_p", prediction), y, "_p").select(F.col("value").alias("score"))


def with_bar(scores: DataFrame) -> DataFrame:
    """Mark the best baseline (``baseline, metric, score, is_bar``); a handful of rows, one per baseline."""
    bar = scores.agg(F.max_by("baseline", F.struct("score", "baseline"))).scalar()
    return scores.withColumn("is_bar", F.col("baseline") == bar)


def baselines(train: DataFrame, test: DataFrame, y: str, features: list[str], metric: str | None = None, ts: str | None = None,
              key: str | None = None, balanced: bool = False, trees: int = 100) -> DataFrame:
    """``baseline, metric, score, is_bar`` of every baseline that fits the task (read from the metric)."""
    metric = metric or "roc_auc"
    a, b = encode(train, test, features)
    used = list(dict.fromkeys([*features, y]))  # read again and again
    a, b = (stored(x.where(~is_null(train, y)).select(*used), "encoded") for x in (a, b))

    def line(name: str, score: DataFrame) -> DataFrame:
        return score.select(F.lit(name).alias("baseline"), F.lit(metric).alias("metric"), "score")

    def scored(pred: DataFrame, **weight) -> DataFrame:
        return METRICS[metric](pred, "_label", "_p", **weight).select(F.col("value").alias("score"))

    if metric == "neg_rmse":
        rows = [line("mean", mean_predictor(a, b, y)),
                line("ridge", scored(ridge(a, b, y, features))),
                line("boosted", scored(boosted(a, b, y, features, "regression", trees)))]
        if ts and key:
            rows.append(line("last_value", last_value(train, test, y, ts, key)))
    else:
        counts = metric in ("roc_auc", "average_precision")  # these take counted rows
        rows = [line("trivial", trivial(a, b, y, metric)),
                line("logistic", scored(logistic(a, b, y, features, balanced))),
                line("boosted", scored(boosted(a, b, y, features, trees=trees, counted=counts), **{"weight": "_weight"} if counts else {}))]
    return with_bar(union_all(rows))


def _lagged(df: DataFrame, series: str, period: str, y: str, lags: dict[str, int]) -> DataFrame:
    def add(frame: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("_at")
        return frame.withColumns({n: F.lag(y, k).over(w) for n, k in lags.items()})

    return framed(df.withColumn("_at", micros(period)), series, ["_at"], add, back=max(lags.values())).drop("_at")


def seasonal_naive(df: DataFrame, series: str, period: str, y: str, season: int) -> DataFrame:
    """Input plus ``last_value`` and ``seasonal_naive`` forecasts of each period from its own past."""
    return _lagged(df, series, period, y, {"last_value": 1, "seasonal_naive": season})


def backtest(df: DataFrame, folds: DataFrame, series: str, period: str, y: str, season: int) -> DataFrame:
    """``series, model, fold, score``: negative mean absolute error per walk-forward window.

    Forecasts reach over the whole test window: the last train value, or the value at the same place of the last
    train season. Values are fetched by equi-joins on (series, period index).
    """
    calendar = numbered(folds, period).select(period, "_i")
    values = df.join(calendar, period).select(series, "_i", y)
    plan = folds.join(calendar, period)
    ends = plan.where("role = 'train'").groupBy("fold").agg(F.max("_i").alias("_end"))
    tests = plan.where("role = 'test'").join(ends, "fold").select("fold", "_i", "_end")
    place = F.pmod(F.col("_i") - F.col("_end") - 1, F.lit(season))
    asked = tests.withColumn("_from", F.explode(F.array(
        F.struct(F.lit("last_value").alias("model"), F.col("_end").alias("at")),
        F.struct(F.lit("seasonal_naive").alias("model"), (F.col("_end") - season + 1 + place).alias("at")))))
    source = values.select(series, F.col("_i").alias("_at"), F.col(y).alias("_guess"))
    pairs = values.join(asked.select("fold", "_i", "_from.model", F.col("_from.at").alias("_at")), "_i").join(
        source, [series, "_at"])
    return pairs.groupBy(series, "model", "fold").agg((-F.avg(F.abs(F.col(y) - F.col("_guess")))).alias("score"))


def unit_root(df: DataFrame, series: str, period: str, y: str, critical: float = -2.86) -> DataFrame:
    """``series, n, slope, t, stationary``: Dickey-Fuller regression of the change on the level before, no lags."""
    pairs = _lagged(df, series, period, y, {"_x": 1}).where("_x is not null").withColumn("_d", F.col(y) - F.col("_x"))
    row = pairs.groupBy(series).agg(
        F.count("_d").alias("n"), F.regr_slope("_d", "_x").alias("slope"), F.regr_sxx("_d", "_x").alias("_sxx"),
        F.regr_syy("_d", "_x").alias("_syy"), F.regr_sxy("_d", "_x").alias("_sxy"))
    sse = F.col("_syy") - F.col("slope") * F.col("_sxy")
    se = F.sqrt(F.try_divide(F.try_divide(sse, F.col("n") - 2), F.col("_sxx")))
    return row.select(series, "n", "slope", F.try_divide("slope", se).alias("t")).withColumn(
        "stationary", F.col("t") < critical)


def leftover_season(df: DataFrame, series: str, period: str, y: str, season: int, position: Column) -> DataFrame:
    """``series, position, n, residual``: mean error of the seasonal-naive forecast by place in the cycle."""
    known = _lagged(df, series, period, y, {"_s": season}).where("_s is not null")
    return known.groupBy(series, position.alias("position")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y) - F.col("_s")).alias("residual"))
