"""Choosing among logged experiments, per group: one-standard-error champion, Pareto front, stop check."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Complexity rank of model families; anything else ranks last.
COMPLEXITY = {
    "DummyClassifier": 1, "DummyRegressor": 1,
    "LogisticRegression": 2, "Ridge": 2, "Lasso": 2, "LinearRegression": 2, "SGDClassifier": 2,
    "DecisionTreeClassifier": 3, "DecisionTreeRegressor": 3,
    "RandomForestClassifier": 4, "RandomForestRegressor": 4,
    "GradientBoostingClassifier": 5, "GradientBoostingRegressor": 5, "XGBClassifier": 5, "XGBRegressor": 5,
    "LGBMClassifier": 5, "LGBMRegressor": 5, "CatBoostClassifier": 5, "CatBoostRegressor": 5,
    "MLPClassifier": 6, "MLPRegressor": 6,
}
OTHER = 7


def complexity(model_type: str = "model_type") -> Column:
    table = F.create_map(*[x for k, v in COMPLEXITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.col(model_type)), F.lit(OTHER))


def array_se(col: str) -> Column:
    """Sample standard deviation over sqrt(k) of an array; NULL under two values."""
    k = F.size(col)
    mean = F.aggregate(col, F.lit(0.0), lambda a, x: a + x) / k
    squares = F.aggregate(col, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(k >= 2, F.sqrt(squares / (k - 1)) / F.sqrt(k))


def _signed(higher: bool) -> Column:
    return F.col("metric_value") if higher else -F.col("metric_value")


def champion(exp: DataFrame, group: str, higher: bool = True, contract: str | None = None,
             metric: str | None = None) -> DataFrame:
    """``group, name, model_type, metric_value, se, within_1se, total, metric_mismatches``.

    The least complex experiment within one standard error of the best. Experiments of the current contract count
    where a group has any, else all do; rows logged under another metric name are counted.
    """
    rows = exp.withColumns({"_c": complexity(), "_v": _signed(higher)})
    if contract is not None:
        mine = F.coalesce(F.col("contract_hash") == contract, F.lit(False))
        any_mine = rows.groupBy(group).agg(F.max(mine).alias("_any"))
        rows = rows.join(any_mine, group).where(mine | ~F.col("_any")).drop("_any")
    off = F.count_if(F.col("metric_name") != metric) if metric else F.lit(0).cast("bigint")
    best = rows.groupBy(group).agg(F.max(F.struct("_v", "fold_scores")).alias("_b"), F.count(F.lit(1)).alias("total"),
                                   off.alias("metric_mismatches"))
    best = best.select(group, "total", "metric_mismatches", F.col("_b._v").alias("_top"), F.col("_b.fold_scores").alias("_f"))
    best = best.withColumn("se", F.coalesce(array_se("_f"), F.abs("_top") * 0.02)).drop("_f")
    near = rows.join(best, group).where(F.col("_v") >= F.col("_top") - F.col("se"))
    pick = F.min(F.struct("_c", (-F.col("_v")).alias("_o"), "name", "model_type", "metric_value")).alias("p")
    return near.groupBy(group, "se", "total", "metric_mismatches").agg(pick, F.count(F.lit(1)).alias("within_1se")).select(
        group, "p.name", "p.model_type", "p.metric_value", "se", "within_1se", "total", "metric_mismatches")


def pareto(exp: DataFrame, group: str, higher: bool = True) -> DataFrame:
    """``group, name, complexity, metric_value`` of experiments no simpler one matches.

    Only the best experiment of each complexity can be on the front, so a group shrinks to a handful of rows first.
    """
    rows = exp.withColumns({"complexity": complexity(), "_v": _signed(higher)})
    best = rows.groupBy(group, "complexity").agg(F.max_by(F.struct("name", "metric_value"), F.struct("_v", "name")).alias("b"),
                                                 F.max("_v").alias("_v"))
    w = Window.partitionBy(group).orderBy(F.desc("_v"), "complexity").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_m", F.min("complexity").over(w)).where(
        F.col("_m").isNull() | (F.col("complexity") < F.col("_m"))).select(group, "b.name", "complexity", "b.metric_value")


def se_floor(exp: DataFrame, group: str, threshold: float = 0.5, higher: bool = True) -> DataFrame:
    """``group, gap, se, continue``: stop tuning when the top two differ by less than a share of the best one's SE.

    Goes on with under two experiments or without fold scores.
    """
    w = Window.partitionBy(group).orderBy(F.desc("_v"), "name")
    top = exp.withColumn("_v", _signed(higher)).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    row = top.groupBy(group).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_r") == 2, F.col("_v"))).alias("_b"),
        F.max(F.when(F.col("_r") == 1, array_se("fold_scores"))).alias("se"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    return row.select(group, gap.alias("gap"), "se", F.coalesce(gap >= threshold * F.col("se"), F.lit(True)).alias("continue"))
