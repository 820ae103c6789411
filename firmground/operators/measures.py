"""Domain measures: credit scorecards and marketing effects."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from firmground.functions.columns import DAY_US, micros, pearson
from firmground.functions.ordering import framed, grouped_running
from firmground.operators.monitor import FLOOR, bucket_cells
from firmground.operators.splits import kfold


def woe(df: DataFrame, y: str, cols: list[str], bins: int = 10) -> DataFrame:
    """``feature, bin, n, bad, woe, iv_part``: numbers cut at their quantiles, text by value.

    Weight of evidence is ln(share of good / share of bad), good being y = 0; empty shares count as the floor.
    """
    (cells,), _ = bucket_cells(df, [df.where(F.col(y).isNotNull()).select(y, *cols)], cols, bins)
    counts = cells.groupBy(F.col("_cell.column").alias("feature"), F.col("_cell.bucket").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == 1).cast("bigint")).alias("bad"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_n"), F.sum("bad").alias("_b"))
    good = F.greatest(F.try_divide(F.col("n") - F.col("bad"), F.col("_n") - F.col("_b")), F.lit(FLOOR))
    bad = F.greatest(F.try_divide("bad", "_b"), F.lit(FLOOR))
    return counts.join(totals, "feature").select(
        "feature", "bin", "n", "bad", F.log(good / bad).alias("woe"), ((good - bad) * F.log(good / bad)).alias("iv_part"))


def information_value(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(F.sum("iv_part").alias("iv"), F.count(F.lit(1)).alias("bins"))


def vintage(df: DataFrame, start: str, event: str, max_age: int) -> DataFrame:
    """``cohort, age, size, events, cum_events, rate``: share of each start-month cohort with the event by age in months."""
    cohort = F.to_date(F.date_trunc("month", start))
    age = (F.year(event) * 12 + F.month(event)) - (F.year(start) * 12 + F.month(start))
    rows = df.select(cohort.alias("cohort"), age.cast("int").alias("age"))
    sizes = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("size"))
    hits = rows.where(F.col("age").between(0, max_age)).groupBy("cohort", "age").agg(F.count(F.lit(1)).alias("events"))
    grid = sizes.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(max_age))))
    w = Window.partitionBy("cohort").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(hits, ["cohort", "age"], "left").fillna(0, ["events"]).withColumn("cum_events", F.sum("events").over(w))
    return full.select("cohort", "age", "size", "events", "cum_events", (F.col("cum_events") / F.col("size")).alias("rate"))


def roll_rates(df: DataFrame, entity: str, period: str, state: str) -> DataFrame:
    """``from_state, to_state, n, share``: moves between an entity's consecutive integer periods."""
    def step(frame: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(period)
        return frame.withColumns({"_from": F.lag(state).over(w), "_gap": F.col(period) - F.lag(period).over(w)})

    moves = framed(df.select(entity, period, state), entity, [period], step).where("_gap = 1").groupBy(
        F.col("_from").alias("from_state"), F.col(state).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    whole = moves.groupBy("from_state").agg(F.sum("n").alias("_all"))
    return moves.join(whole, "from_state").select("from_state", "to_state", "n", (F.col("n") / F.col("_all")).alias("share"))


def expected_loss(df: DataFrame, by: str, pd: Column, lgd: Column, ead: Column) -> DataFrame:
    """``<by>, n, exposure, expected_loss, loss_rate``."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(ead).alias("exposure"), F.sum(pd * lgd * ead).alias("expected_loss")
                              ).withColumn("loss_rate", F.try_divide("expected_loss", "exposure"))


def attribution(df: DataFrame, entity: str, ts: str, key: str, channel: str, converted: Column) -> DataFrame:
    """``channel, first, last, linear``: conversion credit of the touches since the entity's previous conversion.

    Each touch learns by a running count which conversion it leads to; credit is then plain grouping.
    """
    rows = df.select(entity, micros(ts).alias("_at"), F.col(key).alias("_k"), F.col(channel).alias("channel"),
                     converted.cast("int").alias("_c"))
    path = grouped_running(rows, entity, [entity], ["_at", "_k"], {"_upto": ("sum", "_c")})
    path = path.withColumn("_path", F.col("_upto") - F.col("_c"))
    closed = path.groupBy(entity, "_path").agg(
        F.max("_c").alias("done"), F.min_by("channel", F.when(F.col("_c") == 0, F.struct("_at", "_k"))).alias("first"),
        F.max_by("channel", F.when(F.col("_c") == 0, F.struct("_at", "_k"))).alias("last"),
        F.count_if(F.col("_c") == 0).alias("touches")).where("done = 1 and touches > 0")
    parts = path.where("_c = 0").groupBy(entity, "_path", "channel").agg(F.count(F.lit(1)).alias("n"))
    linear = parts.join(closed, [entity, "_path"]).groupBy("channel").agg(F.sum(F.col("n") / F.col("touches")).alias("linear"))
    first = closed.groupBy(F.col("first").alias("channel")).agg(F.count(F.lit(1)).alias("first"))
    last = closed.groupBy(F.col("last").alias("channel")).agg(F.count(F.lit(1)).alias("last"))
    return linear.join(first, "channel", "left").join(last, "channel", "left").fillna(0, ["first", "last"])


def cac_ltv(customers: DataFrame, revenue: DataFrame, spend: DataFrame, entity: str, channel: str, acquired: str, ts: str,
            amount: str, cost: str, horizon_days: int, until: str) -> DataFrame:
    """``channel, customers, cac, ltv, ltv_cac`` with revenue inside the stated horizon, for customers who completed it."""
    day = F.lit(DAY_US)
    ready = customers.where(micros(acquired) + horizon_days * day <= micros(F.to_timestamp(F.lit(until)))).select(
        entity, channel, micros(acquired).alias("_a"))
    inside = (F.col("_t") >= F.col("_a")) & (F.col("_t") < F.col("_a") + horizon_days * day)
    earned = ready.join(revenue.select(entity, micros(ts).alias("_t"), F.col(amount).alias("_v")), entity, "left").groupBy(
        channel).agg(F.sum(F.when(inside, F.col("_v")).otherwise(0.0)).alias("_rev"))
    heads = ready.groupBy(channel).agg(F.count(F.lit(1)).alias("customers"))
    table = heads.join(earned, channel).join(spend.groupBy(channel).agg(F.sum(cost).alias("_cost")), channel, "left")
    cac, ltv = F.try_divide("_cost", "customers"), F.try_divide("_rev", "customers")
    return table.select(F.col(channel).alias("channel"), "customers", cac.alias("cac"), ltv.alias("ltv"),
                        F.try_divide(ltv, cac).alias("ltv_cac"))


def response_curve(df: DataFrame, spend: str, response: str, key: str, buckets: int = 10, scale: int = 100) -> DataFrame:
    """``bucket, n, spend, response, marginal``: equal-count spend buckets and the return of each further unit.

    Spend is ordered in steps of 1 / scale; the last step runs over one row per bucket.
    """
    cut = kfold(df, F.round(F.col(spend) * scale).cast("bigint"), key, buckets, "bucket")
    table = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(spend).alias("spend"), F.avg(response).alias("response"))
    w = Window.partitionBy(F.lit(0)).orderBy("bucket")
    return table.withColumn("marginal", F.try_divide(F.col("response") - F.lag("response").over(w),
                                                     F.col("spend") - F.lag("spend").over(w)))


def calendar_confound(df: DataFrame, ts: str, spend: str, promo: Column, limit: float = 0.3) -> DataFrame:
    """``corr_sin, corr_cos, corr_promo, confounded``: does spend follow the calendar or the promotions?"""
    angle = F.dayofyear(ts) * F.lit(2 * math.pi / 365.25)
    row = df.select(F.col(spend).cast("double").alias("s"), F.sin(angle).alias("a"), F.cos(angle).alias("b"),
                    promo.cast("double").alias("c")).agg(
        pearson("s", "a").alias("corr_sin"), pearson("s", "b").alias("corr_cos"), pearson("s", "c").alias("corr_promo"))
    worst = F.greatest(*[F.abs(c) for c in ("corr_sin", "corr_cos", "corr_promo")])
    return row.withColumn("confounded", worst > limit)
