"""Threshold economics, score bands, overrides and confusion tables."""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F


def threshold_sweep(df: DataFrame, y: str, p: str, cost: dict[str, float], n: int = 100) -> DataFrame:
    """``t, tp, fp, fn, tn, ev, flagged`` at n evenly spaced thresholds from the lowest to the highest score.

    One pass: each row adds to the counter of the highest threshold it reaches; suffix sums run over n counters.
    """
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    lo, hi = known.agg(F.min(p).cast("double"), F.max(p).cast("double")).first()
    if lo is None:
        raise ValueError("no scored rows")
    step = (hi - lo) / (n - 1)
    cuts = [lo + i * step for i in range(n - 1)] + [hi] if hi > lo else [lo]
    reach = Bucketizer(splits=[*cuts, float("inf")], inputCol="_p", outputCol="_i").transform(
        known.select(F.col(p).cast("double").alias("_p"), (F.col(y) == 1).cast("bigint").alias("pos"),
                     (F.col(y) == 0).cast("bigint").alias("neg")))
    counts = reach.groupBy(F.col("_i").cast("int").alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = df.sparkSession.range(len(cuts)).select(
        F.col("id").cast("int").alias("i"), F.get(F.array(*[F.lit(c) for c in cuts]), F.col("id").cast("int")).alias("t"))
    full = grid.join(counts, "i", "left").fillna(0, ["pos", "neg"])
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("i"))
    whole = Window.partitionBy(F.lit(0))
    c = {k: F.lit(float(cost.get(k, 0.0))) for k in ("tp", "fp", "fn", "tn")}
    sums = full.select("t", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
                       F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n")).withColumns({
        "fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    ev = sum((F.col(k) * c[k] for k in ("fp", "fn", "tn")), F.col("tp") * c["tp"])
    return sums.select("t", "tp", "fp", "fn", "tn", ev.alias("ev"), (F.col("tp") + F.col("fp")).alias("flagged"))


def choose(sweep: DataFrame, capacity: int | None = None) -> DataFrame:
    """The threshold of the largest expected value (lowest on ties) and the ones a review capacity allows.

    ``cap_t_high`` is the highest feasible threshold, which flags fewest; ``cap_t_low`` the lowest, which uses the
    capacity. ``agree`` compares the highest one with the value-optimal threshold.
    """
    best = F.max(F.struct(F.col("ev"), (-F.col("t")).alias("m"))).alias("b")
    fits = F.lit(True) if capacity is None else F.col("flagged") <= capacity
    high = F.max(F.when(fits, F.struct("t", "flagged"))).alias("h")
    low = F.min(F.when(fits, F.struct("t", "flagged"))).alias("l")
    row = sweep.agg(best, high, low).select(
        (-F.col("b.m")).alias("ev_t"), F.col("b.ev").alias("ev"), F.col("h.t").alias("cap_t_high"),
        F.col("h.flagged").alias("flagged_high"), F.col("l.t").alias("cap_t_low"), F.col("l.flagged").alias("flagged_low"))
    near = F.abs(F.col("ev_t") - F.col("cap_t_high")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("cap_t_high")
    return row.withColumn("agree", near)


def band_of(p: str, bands: list[tuple[float, str]]):
    """Action of the highest band start not above the score; ``bands`` are ascending (start, action)."""
    out = F.lit(None).cast("string")
    for start, action in bands:
        out = F.when(F.col(p) >= start, F.lit(action)).otherwise(out)
    return out


def score_bands(df: DataFrame, y: str, p: str, bands: list[tuple[float, str]], gain: dict[str, tuple[float, float]]) -> DataFrame:
    """``band, n, share, observed, ev``; ``gain`` gives each action's value for a positive and for a negative case."""
    table = df.groupBy(band_of(p, bands).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == 1).cast("bigint")).alias("_pos"))
    hit, miss = F.lit(0.0), F.lit(0.0)
    for action, (a, b) in gain.items():
        hit, miss = (F.when(F.col("band") == action, F.lit(float(v))).otherwise(o) for v, o in ((a, hit), (b, miss)))
    whole = Window.partitionBy(F.lit(0))
    return table.select("band", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"),
                        (F.col("_pos") / F.col("n")).alias("observed"),
                        (F.col("_pos") * hit + (F.col("n") - F.col("_pos")) * miss).alias("ev"))


def overrides(df: DataFrame, model: str, final: str, band: str) -> DataFrame:
    """``band, n, up_rate, down_rate, override_rate`` of human decisions against the model's (both 0/1)."""
    up = ((F.col(final) == 1) & (F.col(model) == 0)).cast("int")
    down = ((F.col(final) == 0) & (F.col(model) == 1)).cast("int")
    return df.groupBy(F.col(band).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(up).alias("up_rate"), F.avg(down).alias("down_rate"),
        F.avg(up + down).alias("override_rate"))


def confusion(df: DataFrame, y: str, pred: str, by: str) -> DataFrame:
    """``slice, y, pred, n`` overall (slice NULL) and for the slice with the highest error rate."""
    cells = df.groupBy(F.col(by).alias("slice"), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    rate = F.sum(F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")
    worst = cells.where("slice is not null").groupBy("slice").agg(rate.alias("r")).orderBy(F.desc("r"), "slice").limit(1)
    every = cells.groupBy("y", "pred").agg(F.sum("n").alias("n")).withColumn("slice", F.lit(None).cast("string"))
    named = cells.join(worst.select("slice"), "slice", "left_semi").withColumn("slice", F.col("slice").cast("string"))
    return every.select("slice", "y", "pred", "n").unionByName(named.select("slice", "y", "pred", "n"))
