"""Drift, decay, operational load, contracts, parity and rollout checks."""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from firmground.functions.columns import (
    attach, exploded, is_null, is_numeric, join_by, md5_bucket, micros, union_all, whole_days,
)
from firmground.functions.ordering import CHUNK, quantiles, running, value_counts
from firmground.functions.stats import normal_p, two_proportion_z
from firmground.operators.audit import PERIODS, grain_check

# Share floor and the bands of the stability index.
FLOOR = 1e-4
MODERATE, SIGNIFICANT = 0.1, 0.25


def bucket_cells(ref: DataFrame, frames: list[DataFrame], cols: list[str], bins: int) -> tuple[list[DataFrame], dict[str, str]]:
    """Long ``column, bucket`` cells of each frame, numeric columns cut at the reference quantiles.

    Numeric bins are right-closed with open ends; a numeric column with under two bins is left out, nulls too.
    """
    num = [c for c in cols if is_numeric(ref, c)]
    kinds = {c: "numeric" if c in num else "categorical" for c in cols}
    cuts: dict[str, list[float]] = {}
    if num:
        probs = [i / bins for i in range(bins + 1)]
        for r in quantiles(ref, num, probs).collect():
            edges = sorted({r[f"q{i}"] for i in range(bins + 1)})
            if len(edges) >= 3:
                cuts[r["column"]] = edges[1:-1]
    used = [c for c in cols if c in cuts or kinds[c] == "categorical"]
    out = []
    for df in frames:
        work = df
        for c, inner in cuts.items():
            splits = [-math.inf, *[-e for e in reversed(inner)], math.inf]
            value = F.when(~is_null(df, c), -F.col(c).cast("double"))
            work = Bucketizer(splits=splits, inputCol="_neg", outputCol=f"_b_{c}", handleInvalid="keep").transform(
                work.withColumn("_neg", value)).drop("_neg")
        cells = [F.struct(F.lit(c).alias("column"), (
            (F.lit(len(cuts[c])) - F.col(f"_b_{c}").cast("int")).cast("string") if c in cuts
            else F.col(c).cast("string")).alias("bucket")) for c in used]
        out.append(work.withColumn("_cell", F.explode(F.array(*cells))).where("_cell.bucket is not null"))
    return out, kinds


def _term(cur: Column, ref: Column) -> Column:
    c, r = F.greatest(cur, F.lit(FLOOR)), F.greatest(ref, F.lit(FLOOR))
    return (c - r) * F.log(c / r)


def _banded(table: DataFrame, kinds: dict[str, str], threshold: float) -> DataFrame:
    kind = F.lit(None).cast("string")
    for c, k in kinds.items():
        kind = F.when(F.col("column") == c, k).otherwise(kind)
    band = F.when(F.col("psi") < MODERATE, "negligible").when(F.col("psi") <= SIGNIFICANT, "moderate").otherwise(
        "significant")
    return table.withColumns({"kind": kind, "band": band, "flagged": F.col("psi") > threshold})


def psi(ref: DataFrame, cur: DataFrame, cols: list[str] | None = None, bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """``column, kind, psi, band, flagged`` of every shared column, most drifted first."""
    cols = cols or [c for c in ref.columns if c in cur.columns]
    (a, b), kinds = bucket_cells(ref, [ref.select(*cols), cur.select(*cols)], cols, bins)
    cells = a.select("_cell.*", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        b.select("_cell.*", F.lit(0).alias("r"), F.lit(1).alias("c")))
    counts = cells.groupBy("column", "bucket").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    totals = counts.groupBy("column").agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    parts = counts.join(totals, "column").where("_r > 0 and _c > 0")
    table = parts.groupBy("column").agg(F.sum(_term(F.col("c") / F.col("_c"), F.col("r") / F.col("_r"))).alias("psi"))
    return _banded(table, kinds, threshold).select("column", "kind", "psi", "band", "flagged").orderBy(
        F.desc("psi"), "column")


def skew_over_time(ref: DataFrame, cur: DataFrame, ts: str, freq: str, cols: list[str], bins: int = 10,
                   threshold: float = 0.25) -> DataFrame:
    """``period, column, psi, …`` of each serving period against the training reference.

    Buckets a period never saw enter through one per-column sum over the reference, so periods and buckets are never
    multiplied out.
    """
    stamped = cur.select(*cols, F.to_date(F.date_trunc(PERIODS[freq], ts)).alias("period"))
    (a, b), kinds = bucket_cells(ref, [ref.select(*cols), stamped], cols, bins)
    rc = a.select("_cell.*").groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("r"))
    rt = rc.groupBy("column").agg(F.sum("r").alias("_r"))
    share = rc.join(rt, "column").select("column", "bucket", (F.col("r") / F.col("_r")).alias("rp"))
    absent = share.groupBy("column").agg(F.sum(_term(F.lit(0.0), F.col("rp"))).alias("_all"))
    cc = b.select("period", "_cell.*").groupBy("period", "column", "bucket").agg(F.count(F.lit(1)).alias("c"))
    ct = cc.groupBy("period", "column").agg(F.sum("c").alias("_c"))
    seen = cc.join(ct, ["period", "column"]).join(share, ["column", "bucket"], "left")
    delta = _term(F.col("c") / F.col("_c"), F.coalesce("rp", F.lit(0.0))) - F.when(
        F.col("rp").isNotNull(), _term(F.lit(0.0), F.col("rp"))).otherwise(0.0)
    table = seen.groupBy("period", "column").agg(F.sum(delta).alias("_d")).join(absent, "column").select(
        "period", "column", (F.col("_d") + F.col("_all")).alias("psi"))
    return _banded(table, kinds, threshold).select("period", "column", "kind", "psi", "band", "flagged")


def score_ks(ref: DataFrame, cur: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``ks, p_value, alert``: two-sample Kolmogorov-Smirnov distance and its asymptotic p-value."""
    both = ref.select(p, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        cur.select(p, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = value_counts(both, [p], None, {"a": F.col("a"), "b": F.col("b")})
    seen = running(counts, ["value"], {"ua": ("sum", "a"), "ub": ("sum", "b")}, chunk_col=CHUNK)
    full = attach(seen, counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    gap = F.abs(F.try_divide("ua", "na") - F.try_divide("ub", "nb"))
    row = full.agg(F.max(gap).alias("ks"), F.first("na").cast("double").alias("na"), F.first("nb").cast("double").alias("nb"))
    lam2 = F.col("ks") * F.col("ks") * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(
        -2.0) * F.exp(-2.0 * j * j * lam2))
    return row.select("ks", F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)).alias("p_value")).withColumn(
        "alert", F.col("p_value") < alpha)


def decay(scores: DataFrame, period: str, value: str, baseline: float, se: float, run: int = 2,
          step_days: int = 7) -> DataFrame:
    """``period, value, below, trigger``: under baseline - 2 SE, and for ``run`` periods of the calendar in a row.

    One row per period enters, so the ordering runs over a calendar, not over the scored rows. Periods lie ``step_days``
    apart; a missing one breaks a run.
    """
    below = F.col("value") < baseline - 2 * se
    w = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(-(run - 1), 0)
    rows = scores.select(F.col(period).alias("period"), F.col(value).alias("value")).withColumn("below", below)
    whole = F.datediff("period", F.first("period").over(w)) == step_days * (run - 1)
    return rows.withColumn("trigger", (F.sum(F.col("below").cast("int")).over(w) == run) & whole)


def queue_size(df: DataFrame, ts: str, flagged: Column, capacity: int, launch: float) -> DataFrame:
    """``day, queue, over_capacity, drift`` of the flagged rows per day, drift against the launch level."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count_if(flagged).alias("queue")).select(
        "day", "queue", (F.col("queue") > capacity).alias("over_capacity"), (F.col("queue") / launch - 1).alias("drift"))


def action_rate(df: DataFrame, ts: str, flagged: Column, acted: Column, least: float = 0.5) -> DataFrame:
    """``week, flagged, rate, trigger``: share of the flagged rows acted on."""
    return df.where(flagged).groupBy(F.to_date(F.date_trunc("week", ts)).alias("week")).agg(
        F.count(F.lit(1)).alias("flagged"), F.avg(acted.cast("int")).alias("rate")).withColumn(
        "trigger", F.col("rate") < least)


def triggers(drift: DataFrame, decayed: DataFrame, actions: DataFrame, top_features: list[str], limit: float = 0.2) -> DataFrame:
    """``check, fired, hits``: drift on a top feature, decay, and too few actions."""
    def line(name: str, hits: DataFrame) -> DataFrame:
        return hits.agg(F.count(F.lit(1)).alias("hits")).select(
            F.lit(name).alias("check"), (F.col("hits") > 0).alias("fired"), "hits")

    return union_all([
        line("input_drift", drift.where(F.col("column").isin(top_features[:5]) & (F.col("psi") > limit))),
        line("performance_decay", decayed.where("trigger")), line("action_rate", actions.where("trigger"))])


def parity_diff(a: DataFrame, b: DataFrame, keys: list[str], features: list[str], tol: float = 1e-9) -> DataFrame:
    """``feature, n_rows, mismatches, rate, max_diff, only_a, only_b`` of the same features computed twice."""
    l = a.select(*keys, F.struct(*features).alias("l"))
    r = b.select(*keys, F.struct(*features).alias("r"))
    both = l.join(r, keys, "full_outer")
    in_both = F.col("l").isNotNull() & F.col("r").isNotNull()
    aggs, rows = [F.count_if(in_both).alias("m"), F.count_if(F.col("r").isNull()).alias("oa"),
                  F.count_if(F.col("l").isNull()).alias("ob")], []
    for i, f in enumerate(features):
        x, y = F.col(f"l.{f}"), F.col(f"r.{f}")
        if is_numeric(a, f) and is_numeric(b, f):
            gap = F.abs(x.cast("double") - y.cast("double"))
            bad = F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(gap > tol)
        else:
            gap, bad = F.lit(None).cast("double"), ~x.eqNullSafe(y)
        aggs += [F.count_if(in_both & bad).alias(f"b{i}"), F.max(F.when(in_both, gap)).alias(f"g{i}")]
        rows.append(F.struct(F.lit(f).alias("feature"), F.col("m").alias("n_rows"), F.col(f"b{i}").alias("mismatches"),
                             F.try_divide(f"b{i}", "m").alias("rate"), F.col(f"g{i}").alias("max_diff"),
                             F.col("oa").alias("only_a"), F.col("ob").alias("only_b")))
    return exploded(both.agg(*aggs), rows)


def freshness(df: DataFrame, entity: str, ts: str, features: list[str], as_of: str, sla_hours: float) -> DataFrame:
    """``feature, entities, stale, stale_rate, max_age_hours``: age of the last known value per entity."""
    last = df.groupBy(entity).agg(*[F.max(F.when(~is_null(df, f), micros(ts))).alias(f) for f in features])
    now = micros(F.to_timestamp(F.lit(as_of)))
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(features):
        age = (now - F.col(f)) / F.lit(3.6e9)
        aggs += [F.count_if(F.coalesce(age > sla_hours, F.lit(True))).alias(f"s{i}"), F.max(age).alias(f"a{i}")]
        rows.append(F.struct(F.lit(f).alias("feature"), F.col("n").alias("entities"), F.col(f"s{i}").alias("stale"),
                             F.try_divide(f"s{i}", "n").alias("stale_rate"), F.col(f"a{i}").alias("max_age_hours")))
    return exploded(last.agg(*aggs), rows)


def contract_test(df: DataFrame, columns: dict[str, str], grain: list[str] | None = None,
                  null_limits: dict[str, float] | None = None) -> DataFrame:
    """Violations ``check, column, expected, actual`` of a table contract: columns, types, grain, null rates."""
    spark = df.sparkSession
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    facts = [("missing_column", c, k, "absent") for c, k in columns.items() if c not in have]
    facts += [("type", c, k, have[c]) for c, k in columns.items() if c in have and have[c] != k]
    facts += [("extra_column", c, "absent", k) for c, k in have.items() if c not in columns]
    parts = [spark.createDataFrame(facts, "check string, column string, expected string, actual string")]
    if grain and all(c in have for c in grain):
        parts.append(grain_check(df, grain).where("not passed").select(
            F.lit("grain").alias("check"), F.lit(",".join(grain)).alias("column"), F.lit("0").alias("expected"),
            F.col("dup_rows").cast("string").alias("actual")))
    limits = {c: v for c, v in (null_limits or {}).items() if c in have}
    if limits:
        row = df.agg(*[F.avg(is_null(df, c).cast("int")).alias(c) for c in limits])
        parts.append(exploded(row, [F.when(F.col(c) > v, F.struct(
            F.lit("null_rate").alias("check"), F.lit(c).alias("column"), F.lit(str(v)).alias("expected"),
            F.format_number(F.col(c), 4).alias("actual"))) for c, v in limits.items()]))
    return union_all(parts)


def source_freshness(df: DataFrame, ts: str, now: str, hours: int, max_lag_hours: float) -> DataFrame:
    """``recent_rows, lag_hours, passed``: rows in the last hours and the lag of the newest one."""
    at = micros(F.to_timestamp(F.lit(now)))
    row = df.agg(F.count_if(micros(ts) > at - hours * 3_600_000_000).alias("recent_rows"),
                 ((at - F.max(micros(ts))) / F.lit(3.6e9)).alias("lag_hours"))
    return row.withColumn("passed", F.coalesce((F.col("recent_rows") > 0) & (F.col("lag_hours") <= max_lag_hours),
                                               F.lit(False)))


def shadow(a: DataFrame, b: DataFrame, key: list[str], decision: str) -> DataFrame:
    """``champion, challenger, n, share, disagreement`` cross-table of two models' decisions on the same cases.

    Where a key repeats, its copies are numbered on each side in the order of the decision and paired by number; copies
    without a partner are left out. Decisions of a key are counted first, so a key with very many copies is a few rows.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy(*key, F.col(decision).alias(name)).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*key).orderBy(F.col(name).asc_nulls_last()))
        return per.select(*key, name, (upto - F.col("_n")).alias(f"_from_{name}"), upto.alias(f"_to_{name}"))

    met = join_by(counted(a, "champion"), counted(b, "challenger"), key)
    both = F.least("_to_champion", "_to_challenger") - F.greatest("_from_champion", "_from_challenger")
    cells = met.where(both > 0).groupBy("champion", "challenger").agg(F.sum(both).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return cells.select("champion", "challenger", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"), (
        F.sum(F.when(~F.col("champion").eqNullSafe(F.col("challenger")), F.col("n")).otherwise(0)).over(whole)
        / F.sum("n").over(whole)).alias("disagreement"))


def route(df: DataFrame, key: str, frac: float, seed: str = "route") -> DataFrame:
    """``arm``: the stated fraction of keys goes to the challenger, the same keys each time."""
    return df.withColumn("arm", F.when(md5_bucket(key, 10000, f"{seed}:") < int(frac * 10000), "challenger").otherwise(
        "champion"))


def canary(df: DataFrame, arm: str, bad: str, n_min: int, alpha: float = 0.05) -> DataFrame:
    """``n_champion, n_challenger, rate_champion, rate_challenger, stat, p, ready, rollback``.

    Rolls back when the challenger is significantly worse after at least ``n_min`` requests of its own.
    """
    side = {s: F.col(arm) == s for s in ("champion", "challenger")}
    row = df.agg(*[F.count_if(c).alias(f"n_{s}") for s, c in side.items()],
                 *[F.avg(F.when(c, F.col(bad))).alias(f"rate_{s}") for s, c in side.items()])
    z = two_proportion_z(F.col("rate_challenger"), F.col("n_challenger"), F.col("rate_champion"), F.col("n_champion"))
    ready = F.col("n_challenger") >= n_min
    return row.withColumn("stat", z).withColumn("p", normal_p("stat")).withColumn("ready", ready).withColumn(
        "rollback", F.coalesce(ready & (F.col("rate_challenger") > F.col("rate_champion")) & (F.col("p") < alpha),
                               F.lit(False)))


def label_coverage(scored: DataFrame, labels: DataFrame, key: list[str], scored_at: str, known_at: str) -> DataFrame:
    """``scored, labelled, share, lag_p50, lag_p90`` in days."""
    both = scored.join(labels.select(*key, F.col(known_at).alias("_known")), key, "left").select(
        whole_days(F.col("_known"), F.col(scored_at)).alias("lag"), F.col("_known").isNotNull().alias("has"))
    row = both.agg(F.count(F.lit(1)).alias("scored"), F.count_if("has").alias("labelled")).withColumn(
        "share", F.try_divide("labelled", "scored"))
    return attach(row, quantiles(both, ["lag"], [0.5, 0.9]).select(F.col("q0").alias("lag_p50"), F.col("q1").alias("lag_p90")))


def realised_value(acted: DataFrame, outcomes: DataFrame, key: str, ts: str, value: str, freq: str = "M") -> DataFrame:
    """``period, cases, value`` of the cases acted on."""
    return acted.join(outcomes.select(key, value), key, "left").groupBy(
        F.to_date(F.date_trunc(PERIODS[freq], ts)).alias("period")).agg(
        F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))
