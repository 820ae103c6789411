"""Spec-driven feature build and batch scoring; one definition serves batch and streaming frames."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from firmground.functions.columns import exploded, is_null


@dataclass(frozen=True)
class Feature:
    name: str
    formula: str
    dtype: str = "double"
    inputs: tuple[str, ...] = ()


def build(df: DataFrame, spec: list[Feature], key: list[str]) -> tuple[DataFrame, list[str]]:
    """Key and features in spec order, and the names whose stated inputs are absent (those columns are NULL)."""
    missing = [s.name for s in spec if not set(s.inputs) <= set(df.columns)]
    cols = [(F.lit(None) if s.name in missing else F.expr(s.formula)).cast(s.dtype).alias(s.name) for s in spec]
    return df.select(*key, *cols), missing


def validate(built: DataFrame, spec: list[Feature], missing: list[str]) -> DataFrame:
    """``feature, present, known, n_rows, issue``: absent inputs and features without a single value."""
    row = built.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~is_null(built, s.name)).alias(s.name) for s in spec])
    return exploded(row, [F.struct(
        F.lit(s.name).alias("feature"), F.lit(s.name not in missing).alias("present"), F.col(s.name).alias("known"),
        F.col("_n").alias("n_rows"), F.when(F.lit(s.name in missing), "missing_input").when(
            F.col(s.name) == 0, "all_null").otherwise("").alias("issue")) for s in spec])


def score(df: DataFrame, model: Column | object, threshold: float, calibrator: Callable[[DataFrame, str, str], DataFrame] | None = None,
          p: str = "p") -> DataFrame:
    """Adds ``p``, ``p_cal`` and ``decision``; the model is a column expression or a fitted ``PipelineModel``."""
    if isinstance(model, Column):
        scored = df.withColumn(p, model)
    else:
        out = model.transform(df)
        value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        scored = out.withColumn(p, value).select(*df.columns, p)
    scored = calibrator(scored, p, "p_cal") if calibrator else scored.withColumn("p_cal", F.col(p))
    return scored.withColumn("decision", (F.col("p_cal") >= threshold).cast("int"))
