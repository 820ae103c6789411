"""Experiment sizing, read-outs and effect estimates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from firmground.functions.columns import exploded, micros, whole_days
from firmground.functions.ordering import framed, grouped_running
from firmground.functions.stats import normal_p, student_p, two_proportion_z, welch, z_value


def _zz(alpha: float, power: float) -> float:
    return (z_value(1 - alpha / 2) + z_value(power)) ** 2


def sample_size(df: DataFrame, y: str, by: str, mde: float, kind: str = "proportion", relative: bool = False,
                alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """``<by>, baseline, std, mde, n_per_arm``: rows needed per arm, from each segment's own baseline or spread."""
    base, std = F.col("baseline"), F.col("std")
    delta = base * mde if relative else F.lit(float(mde))
    row = df.groupBy(by).agg(F.avg(y).alias("baseline"), F.stddev_samp(y).alias("std")).withColumn("mde", delta)
    if kind == "proportion":
        other = base + F.col("mde")
        spread = base * (1 - base) + other * (1 - other)
    else:
        spread = 2 * std * std
    n = F.try_divide(spread * F.lit(_zz(alpha, power)), F.col("mde") * F.col("mde"))
    return row.withColumn("n_per_arm", F.floor(n).cast("bigint") + 1)


def detectable(df: DataFrame, y: str, by: str, kind: str = "proportion", alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """``<by>, n, baseline, std, detectable``: smallest effect seen at the segment's row count per arm."""
    row = df.groupBy(by).agg(F.count(y).alias("n"), F.avg(y).alias("baseline"), F.stddev_samp(y).alias("std"))
    zz, p, n = F.lit(_zz(alpha, power)), F.col("baseline"), F.col("n")
    if kind == "proportion":
        first = F.sqrt(F.try_divide(zz * 2 * p * (1 - p), n))
        other = p + first
        effect = F.sqrt(F.greatest(F.try_divide(zz * (p * (1 - p) + other * (1 - other)), n), F.lit(0.0)))
    else:
        effect = F.sqrt(F.try_divide(2 * F.col("std") * F.col("std") * zz, n))
    return row.withColumn("detectable", effect)


def to_units(df: DataFrame, unit: str, keep: list[str], aggs: list[Column]) -> DataFrame:
    """One row per randomisation unit."""
    return df.groupBy(unit, *keep).agg(*aggs)


def unit_check(df: DataFrame, unit: str, arm: str) -> DataFrame:
    """``arm, n_rows, n_units, rows_per_unit, mixed_units``: units seen in more than one arm are a broken assignment."""
    per = df.groupBy(unit, arm).agg(F.count(F.lit(1)).alias("c"))
    spread = per.groupBy(unit).agg(F.count(F.lit(1)).alias("arms"))
    return per.join(spread, unit).groupBy(F.col(arm).alias("arm")).agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("arms") > 1).alias("mixed_units")
    ).withColumn("rows_per_unit", F.col("n_rows") / F.col("n_units"))


def arm_readout(units: DataFrame, arm: str, control: str, treated: str,
                metrics: dict[str, tuple[str, str, str, float]], alpha: float = 0.05) -> DataFrame:
    """``metric, role, n_a, n_b, mean_a, mean_b, diff, stat, df, p, ok``.

    ``metrics``: name to (column, rate | mean, primary | guardrail, bar). A primary metric is ok when the gain is at
    least the bar and significant; a guardrail when it does not fall below minus its bar. Side a is the control.
    """
    a, b = F.col(arm) == control, F.col(arm) == treated
    aggs = []
    for i, (col, *_rest) in enumerate(metrics.values()):
        for tag, cond in (("a", a), ("b", b)):
            x = F.when(cond, F.col(col).cast("double"))
            aggs += [F.count(x).alias(f"n{tag}{i}"), F.avg(x).alias(f"m{tag}{i}"), F.var_samp(x).alias(f"v{tag}{i}")]
    row = units.agg(*aggs)
    structs = []
    for i, (name, (_, kind, role, bar)) in enumerate(metrics.items()):
        na, nb, ma, mb = (F.col(f"{k}{i}") for k in ("na", "nb", "ma", "mb"))
        if kind == "rate":
            stat, dof = two_proportion_z(mb, nb, ma, na), F.lit(None).cast("double")
        else:
            stat, dof = welch(mb, F.col(f"vb{i}"), nb, ma, F.col(f"va{i}"), na)
        structs.append(F.struct(
            F.lit(name).alias("metric"), F.lit(role).alias("role"), na.alias("n_a"), nb.alias("n_b"), ma.alias("mean_a"),
            mb.alias("mean_b"), (mb - ma).alias("diff"), stat.alias("stat"), dof.alias("df"), F.lit(float(bar)).alias("bar")))
    table = exploded(row, structs)
    table = table.withColumn("p", F.coalesce(F.when(F.col("df").isNotNull(), student_p("stat", "df")), normal_p("stat")))
    ok = F.when(F.col("role") == "primary", (F.col("diff") >= F.col("bar")) & (F.col("p") < alpha)).otherwise(
        F.col("diff") >= -F.col("bar"))
    return table.withColumn("ok", ok)


def novelty(df: DataFrame, unit: str, ts: str, arm: str, control: str, treated: str, y: str) -> DataFrame:
    """``day, n_a, n_b, effect``: treated minus control by days since the unit's first exposure."""
    start = df.groupBy(unit).agg(F.min(ts).alias("_first"))
    aged = df.join(start, unit).withColumn("day", whole_days(F.col(ts), F.col("_first")))
    a, b = F.when(F.col(arm) == control, F.col(y)), F.when(F.col(arm) == treated, F.col(y))
    return aged.groupBy("day").agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), (F.avg(b) - F.avg(a)).alias("effect"))


def did(df: DataFrame, y: str, treated: Column, post: Column, by: list[str] | None = None) -> DataFrame:
    """``by…, n, control_pre, control_post, treated_pre, treated_post, effect``: difference in differences."""
    cell = {"control_pre": ~treated & ~post, "control_post": ~treated & post,
            "treated_pre": treated & ~post, "treated_post": treated & post}
    row = df.groupBy(*(by or [])).agg(F.count(y).alias("n"), *[F.avg(F.when(c, F.col(y))).alias(k) for k, c in cell.items()])
    return row.withColumn("effect", (F.col("treated_post") - F.col("treated_pre"))
                          - (F.col("control_post") - F.col("control_pre")))


def overlap(df: DataFrame, treated: Column, strata: list[str]) -> DataFrame:
    """``strata…, n_treated, n_control, one_sided``."""
    return df.groupBy(*strata).agg(F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control")
                                   ).withColumn("one_sided", (F.col("n_treated") == 0) | (F.col("n_control") == 0))


def balance(df: DataFrame, treated: Column, covariates: list[str], limit: float = 0.1) -> DataFrame:
    """``covariate, mean_treated, mean_control, smd, unbalanced``: standardised mean differences."""
    aggs, rows = [], []
    for i, c in enumerate(covariates):
        t, k = F.when(treated, F.col(c)), F.when(~treated, F.col(c))
        aggs += [F.avg(t).alias(f"mt{i}"), F.avg(k).alias(f"mc{i}"), F.var_samp(t).alias(f"vt{i}"), F.var_samp(k).alias(f"vc{i}")]
        smd = F.try_divide(F.col(f"mt{i}") - F.col(f"mc{i}"), F.sqrt((F.col(f"vt{i}") + F.col(f"vc{i}")) / 2))
        rows.append(F.struct(F.lit(c).alias("covariate"), F.col(f"mt{i}").alias("mean_treated"),
                             F.col(f"mc{i}").alias("mean_control"), smd.alias("smd"), (F.abs(smd) > limit).alias("unbalanced")))
    return exploded(df.agg(*aggs), rows)


def stratified_effect(df: DataFrame, y: str, treated: Column, strata: list[str]) -> DataFrame:
    """``strata_used, rows_used, effect``: within-stratum differences weighted by stratum size, two-sided strata only."""
    cells = df.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.when(treated, F.col(y))) - F.avg(F.when(~treated, F.col(y)))).alias("d"))
    return cells.where("d is not null").agg(F.count(F.lit(1)).alias("strata_used"), F.sum("n").alias("rows_used"),
                                            F.try_divide(F.sum(F.col("n") * F.col("d")), F.sum("n")).alias("effect"))


def placebo(df: DataFrame, y: str, treated: Column, ts: str, start: str, shams: list[str]) -> DataFrame:
    """``cutoff, real, effect``: the same estimator at the true start and at sham dates before it, on earlier rows only."""
    at = F.to_timestamp(F.lit(start))
    early = F.col(ts) < at.cast(df.schema[ts].dataType)
    aggs, rows = [], []
    for i, (cutoff, real) in enumerate([(start, True), *[(s, False) for s in shams]]):
        post = F.col(ts) >= F.to_timestamp(F.lit(cutoff))
        use = F.lit(True) if real else early
        sides = (treated & post, treated & ~post, ~treated & post, ~treated & ~post)
        aggs += [F.avg(F.when(use & c, F.col(y))).alias(f"c{i}{k}") for k, c in enumerate(sides)]
        effect = (F.col(f"c{i}0") - F.col(f"c{i}1")) - (F.col(f"c{i}2") - F.col(f"c{i}3"))
        rows.append(F.struct(F.lit(cutoff).alias("cutoff"), F.lit(real).alias("real"), effect.alias("effect")))
    return exploded(df.agg(*aggs), rows)


def geo_incrementality(df: DataFrame, geo: str, period_post: Column, treated: Column, revenue: str, spend: str) -> DataFrame:
    """``effect_per_geo, treated_geos, incremental, spend, iroas`` from geo totals before and after the start."""
    totals = df.groupBy(geo).agg(
        F.sum(F.when(period_post, F.col(revenue)).otherwise(0.0)).alias("post"),
        F.sum(F.when(~period_post, F.col(revenue)).otherwise(0.0)).alias("pre"),
        F.sum(F.when(period_post, F.col(spend)).otherwise(0.0)).alias("spend"), F.bool_or(treated).alias("hit"))
    change = F.col("post") - F.col("pre")
    row = totals.agg(
        (F.avg(F.when(F.col("hit"), change)) - F.avg(F.when(~F.col("hit"), change))).alias("effect_per_geo"),
        F.count_if("hit").alias("treated_geos"), F.sum(F.when(F.col("hit"), F.col("spend"))).alias("spend"))
    gain = F.col("effect_per_geo") * F.col("treated_geos")
    return row.select("effect_per_geo", "treated_geos", gain.alias("incremental"), "spend", F.try_divide(gain, F.col("spend")).alias("iroas"))


def unit_sessions(df: DataFrame, unit: str, ts: str, key: str, gap_seconds: int) -> DataFrame:
    """``unit, start, end, n``: runs of a unit's events closer than the gap (end = last event plus the gap).

    Starts are marked against the previous event and numbered by a running count, so that one very active unit is
    never a single task's work.
    """
    def mark(frame: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("_at", key)
        late = F.col("_at") - F.lag("_at").over(w) >= gap_seconds * 1_000_000
        return frame.withColumn("_new", F.coalesce(late, F.lit(True)).cast("int"))

    rows = df.where(F.col(unit).isNotNull()).select(unit, key, micros(ts).alias("_at"))
    marked = framed(rows, unit, ["_at", key], mark)
    numbered = grouped_running(marked, unit, [unit], ["_at", key], {"_s": ("sum", "_new")})
    return numbered.groupBy(unit, "_s").agg(
        F.timestamp_micros(F.min("_at")).alias("start"),
        F.timestamp_micros(F.max("_at") + gap_seconds * 1_000_000).alias("end"), F.count(F.lit(1)).alias("n")).drop("_s")
