"""Leakage scans, split integrity, point-in-time availability and label maturity."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from firmground.functions.columns import (
    as_double, attach, exploded, is_null, is_numeric, micros, pearson, union_all, whole_days,
)
from firmground.functions.ordering import quantiles, running
from firmground.operators.signal import coded_target, filled

# Column-name vocabulary of things known only after the outcome.
POST_OUTCOME = r"resolved|resolution|final_|chargeback|refund|outcome|result|closed_|settlement|actual_"


def post_outcome_name(name: str) -> bool:
    return bool(re.search(POST_OUTCOME, name, re.I))


def leak_scan(df: DataFrame, target: str, threshold: float = 0.98, null_threshold: float = 0.99) -> DataFrame:
    """``column, check, value, flag``: target correlation, null pattern against the target, post-outcome names.

    Correlations fill nulls with the median first; class targets are numbered (see :func:`coded_target`). The null pattern is the share of rows
    where "has a value" agrees with "target is 1", and is read for columns with nulls and a 0/1 target.
    """
    coded = coded_target(df, target)
    feats = [c for c in df.columns if c != target]
    num = [c for c in feats if is_numeric(df, c)]
    ready = filled(coded, num) if num else coded
    aggs, rows = [], []
    for i, c in enumerate(num):
        aggs.append(F.abs(pearson(c, "_y")).alias(f"r{i}"))
        rows.append(F.when(F.col(f"r{i}").isNotNull() & ~F.isnan(f"r{i}"), F.struct(
            F.lit(c).alias("column"), F.lit("corr").alias("check"), F.col(f"r{i}").alias("value"),
            (F.col(f"r{i}") >= threshold).alias("flag"))))
    plain = F.col(target).cast("double") if is_numeric(df, target) else F.col("_y")
    nulls = coded.select(plain.alias("_y"), *[is_null(df, c).alias(c) for c in feats])
    pattern, prow = [], []
    for i, c in enumerate(feats):
        pattern += [F.avg((~F.col(c) == (F.col("_y") == 1)).cast("int")).alias(f"p{i}"),
                    F.max(F.col(c)).alias(f"h{i}")]
        prow.append(F.when(F.col(f"h{i}") & F.col("_binary"), F.struct(
            F.lit(c).alias("column"), F.lit("null_pattern").alias("check"), F.col(f"p{i}").alias("value"),
            (F.col(f"p{i}") >= null_threshold).alias("flag"))))
    pattern.append(F.bool_and(F.col("_y").isin(0.0, 1.0)).alias("_binary"))
    parts = ([exploded(ready.agg(*aggs), rows)] if num else []) + [exploded(nulls.agg(*pattern), prow)]
    named = [(c, "name", None, True) for c in feats if post_outcome_name(c)]
    if named:
        parts.append(df.sparkSession.createDataFrame(named, "column string, check string, value double, flag boolean"))
    return union_all(parts)


def null_pattern(df: DataFrame, feature: str, y: str, threshold: float = 0.99) -> DataFrame:
    """``agreement, leak``: how often the feature has a value exactly where the label is 1."""
    return df.agg(F.avg((~is_null(df, feature) == (F.col(y) == 1)).cast("int")).alias("agreement")).withColumn(
        "leak", F.col("agreement") >= threshold)


def _sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    ka = a.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    kb = b.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    return ka.join(kb, key, "full_outer")


def split_overlap(a: DataFrame, b: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """``n_a, n_b, n_both, share_a, examples``: entities on both sides of a split (examples joined by commas)."""
    keys = _sides(a, b, key)
    both = F.col("_a") & F.col("_b")
    row = keys.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(both).alias("n_both"))
    shown = keys.where(both).orderBy(key).limit(examples).agg(
        F.concat_ws(",", F.array_sort(F.collect_list(key)).cast("array<string>")).alias("examples"))
    return attach(row.withColumn("share_a", F.try_divide("n_both", "n_a")), shown)


def split_assert(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``check, passed, n_bad``: no entity on both sides, and no repeated key in the test side."""
    both = _sides(train, test, key).where(F.col("_a") & F.col("_b")).agg(F.count(F.lit(1)).alias("n_bad"))
    rep = test.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_bad"))
    rows = both.select(F.lit("no_entity_in_both").alias("check"), "n_bad").unionByName(
        rep.select(F.lit("no_duplicate_in_test").alias("check"), "n_bad"))
    return rows.select("check", (F.col("n_bad") == 0).alias("passed"), "n_bad")


def feature_parity(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """``feature, in_a, in_b, same_type, known_a, known_b``: presence, type and non-null rows on each side."""
    def known(df: DataFrame, tag: str) -> DataFrame:
        have = [n for n in names if n in df.columns]
        row = df.agg(*[F.count_if(~is_null(df, n)).alias(n) for n in have])
        return exploded(row, [F.struct(F.lit(n).alias("feature"), F.col(n).alias(f"known_{tag}")) for n in have])

    facts = []
    for n in names:
        ta = a.schema[n].dataType.simpleString() if n in a.columns else None
        tb = b.schema[n].dataType.simpleString() if n in b.columns else None
        facts.append((n, ta is not None, tb is not None, ta == tb if ta and tb else None))
    base = a.sparkSession.createDataFrame(facts, "feature string, in_a boolean, in_b boolean, same_type boolean")
    return base.join(known(a, "a"), "feature", "left").join(known(b, "b"), "feature", "left")


def pit_filter(spine: DataFrame, facts: DataFrame, key: str, decision: str, available: str) -> DataFrame:
    """Source rows some decision of their entity may use, with ``first_decision``, the earliest that may.

    Facts and decisions travel through one order by time, so no pairs of them are made, and an entity with very many is cut
    into chunks. Facts without an entity or a time are never known.
    """
    ask = spine.where(F.col(key).isNotNull() & F.col(decision).isNotNull()).select(
        F.col(key).alias("_key"), micros(decision).alias("_at"), F.lit(1).alias("_ask"), micros(decision).alias("_decided"), F.lit(None).alias("_fact"))
    give = facts.where(F.col(key).isNotNull() & F.col(available).isNotNull()).select(
        F.col(key).alias("_key"), micros(available).alias("_at"), F.lit(0).alias("_ask"), F.lit(None).cast("bigint").alias("_decided"),
        F.struct(*facts.columns).alias("_fact"))
    both = ask.withColumn("_fact", F.lit(None).cast(give.schema["_fact"].dataType)).union(give)
    seen = running(both, ["_at", "_ask"], {"_first": ("min", "_decided")}, ["_key"], descending=True)
    return seen.where("_ask = 0 and _first is not null").select("_fact.*", F.timestamp_micros("_first").alias("first_decision"))


def availability_report(df: DataFrame, decision: str, sources: dict[str, str]) -> DataFrame:
    """``feature, known_rows, late_rows, late_rate``: rows whose source time lies after the decision."""
    aggs, rows = [], []
    for i, (feature, ts) in enumerate(sources.items()):
        aggs += [F.count(ts).alias(f"n{i}"), F.count_if(F.col(ts) > F.col(decision)).alias(f"l{i}")]
        rows.append(F.struct(F.lit(feature).alias("feature"), F.col(f"n{i}").alias("known_rows"),
                             F.col(f"l{i}").alias("late_rows"),
                             F.try_divide(f"l{i}", f"n{i}").alias("late_rate")))
    return exploded(df.agg(*aggs), rows)


def _age(ts: str, until: str) -> Column:
    return whole_days(F.to_timestamp(F.lit(until)), F.col(ts))


def label_maturity(df: DataFrame, ts: str, until: str, days: int) -> DataFrame:
    """``n_rows, n_bad, censored, rate``: rows whose outcome window is still open when observation ends."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(ts).isNull()).alias("n_bad"),
        F.count_if(_age(ts, until) < days).alias("censored"),
    ).withColumn("rate", F.try_divide("censored", F.col("n_rows") - F.col("n_bad")))


def mature_only(df: DataFrame, ts: str, until: str, days: int) -> DataFrame:
    """Rows whose label is final; open ones are left out, never counted as negative.

    The age test is turned into one on the column itself, so that it can reach the scan.
    """
    latest = F.to_timestamp(F.lit(until)) - F.make_dt_interval(F.lit(days))
    return df.where(F.col(ts) <= latest.cast(df.schema[ts].dataType))


def label_lag(df: DataFrame, event: str, known: str, cadence_days: int) -> DataFrame:
    """``n, p50, p90, max_lag, over_cadence``: days from an event until its label is known."""
    lag = df.select(whole_days(F.col(known), F.col(event)).alias("lag")).where("lag is not null")
    marks = quantiles(lag, ["lag"], [0.5, 0.9, 1.0]).select(
        "n", F.col("q0").alias("p50"), F.col("q1").alias("p90"), F.col("q2").alias("max_lag"))
    return attach(marks, lag.agg(F.avg((F.col("lag") > cadence_days).cast("int")).alias("over_cadence")))


def gold_set_shift(gold: DataFrame, population: DataFrame, stratum: str, floor: float = 1e-4) -> DataFrame:
    """``stratum, gold, pop, diff, psi_part``: shares of each stratum in a labelled set and in the population."""
    def share(df: DataFrame, out: str) -> DataFrame:
        counts = df.groupBy(F.coalesce(F.col(stratum), F.lit("(none)")).alias("stratum")).agg(
            F.count(F.lit(1)).alias("n"))
        return counts.withColumn("_all", df.agg(F.count(F.lit(1))).scalar()).select(
            "stratum", (F.col("n") / F.col("_all")).alias(out))

    both = share(gold, "gold").join(share(population, "pop"), "stratum", "full_outer").fillna(0.0, ["gold", "pop"])
    g, p = F.greatest("gold", F.lit(floor)), F.greatest("pop", F.lit(floor))
    return both.withColumn("diff", F.col("gold") - F.col("pop")).withColumn("psi_part", (g - p) * F.log(g / p))
