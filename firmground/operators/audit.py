"""Table audits: grain, keys, nulls, targets, time coverage, linkage, ranges, cohorts, correlations, PII."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from firmground.functions.columns import (
    as_double, attach, collect_stats, exploded, is_null, is_numeric, micros, numeric_columns, pearson, union_all,
    whole_days,
)
from firmground.functions.gram import correlations
from firmground.functions.heavy import repeated, top_counts
from firmground.functions.ordering import framed, quantiles

# Placeholders for "missing", and name parts of columns that should not be negative.
SENTINELS = [-1, -999, 999, 9999, 99999, 999999]
COUNT_LIKE = ("count", "num_", "n_", "qty", "quantity", "total", "amount", "amt", "days", "age")
# Patterns of personal data.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ().-]{7,}[0-9]",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
PERIODS = {"D": "day", "W": "week", "M": "month", "H": "hour"}


def grain_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """``rows, uniques, dup_rows, dup_rate, passed`` of a candidate grain."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("uniques"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("dup_rows"),
    ).select("*", F.try_divide("dup_rows", "rows").alias("dup_rate"), (F.col("dup_rows") == 0).alias("passed"))


def candidate_keys(df: DataFrame, slices: int = 64) -> DataFrame:
    """Columns whose distinct count (null as one value) equals the row count.

    A column is only excluded by a value seen twice. One hash slice of the values is looked at first: there most columns
    show a repeat, and only the others are counted whole.
    """
    left = [c for c in df.columns if c not in repeated(df, df.columns, slices)] if df.columns else []
    twice = repeated(df, left) if left else set()
    return df.sparkSession.createDataFrame([(c,) for c in left if c not in twice], "column string")


def null_rates(df: DataFrame) -> DataFrame:
    """``column, null_rate`` for columns with any null, largest first."""
    parts = []
    for i in range(0, len(df.columns), 100):
        cols = df.columns[i:i + 100]
        rates = df.agg(*[F.avg(is_null(df, c).cast("int")).alias(c) for c in cols])
        parts.append(exploded(rates, [
            F.when(F.col(c) > 0, F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate"))) for c in cols]))
    return union_all(parts).orderBy(F.desc("null_rate"), "column")


def pair_correlations(df: DataFrame, exprs: dict[str, Column], size: int = 300) -> DataFrame:
    """Pairwise-complete Pearson correlation of named expressions: ``col_a, col_b, r`` for each pair a before b, in one scan.

    As many pairs as one aggregation can hold are aggregates; more are sums of matrix products (``functions.gram``).
    """
    names = list(exprs)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    wide = df.select(*[exprs[n].alias(f"c{i}") for i, n in enumerate(names)])
    if len(pairs) > size:
        return correlations(wide, names)
    at = {n: f"c{i}" for i, n in enumerate(names)}
    row = wide.agg(*[pearson(at[a], at[b]).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return exploded(row, [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])


def null_corr(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of columns whose null indicators correlate: ``col_a, col_b, r`` with |r| over the threshold."""
    rates = collect_stats(df, [F.max(is_null(df, c).cast("int")).alias(c) for c in df.columns])
    some = [c for c in df.columns if rates[c]]
    if len(some) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    found = pair_correlations(df, {c: is_null(df, c).cast("double") for c in some})
    return found.where(F.abs("r") > threshold)


def target_counts(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """Most frequent values of a categorical target: ``value, n, share`` of the non-null rows."""
    known = df.where(~is_null(df, target))
    counts = known.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "value").limit(top)
    return first.withColumn("_all", known.agg(F.count(F.lit(1))).scalar()).select(
        "value", "n", F.try_divide("n", "_all").alias("share"))


def minority_rate(df: DataFrame, target: str, limit: float = 0.1) -> DataFrame:
    """``minority_rate, imbalanced`` of a target with exactly two values; no row otherwise."""
    counts = df.where(~is_null(df, target)).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("k"), (F.min("n") / F.sum("n")).alias("minority_rate")).where(
        "k = 2").select("minority_rate", (F.col("minority_rate") < limit).alias("imbalanced"))


def sample_skewness(col: Column | str) -> Column:
    """Bias-corrected skewness; Spark's own is the population form."""
    n = F.count(col).cast("double")
    return F.when(n > 2, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """``mean, std, min, p50, max, skew, heavy`` of a continuous target."""
    x = as_double(df, target)
    row = df.select(x.alias(target)).agg(
        F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.min(target).alias("min"),
        F.max(target).alias("max"), sample_skewness(target).alias("skew"))
    mid = quantiles(df, [target], [0.5]).select(F.col("q0").alias("p50"))
    return attach(row, mid).withColumn("heavy", F.abs("skew") > 1)


def _as_time(df: DataFrame, col: str) -> Column:
    return F.try_to_timestamp(F.col(col)) if isinstance(df.schema[col].dataType, T.StringType) else F.col(col)


def time_coverage(df: DataFrame, ts: str) -> DataFrame:
    """``min_date, max_date, days, n_bad``."""
    stamped = df.select(F.col(ts), _as_time(df, ts).alias("_ts"))
    return stamped.agg(
        F.min("_ts").alias("lo"), F.max("_ts").alias("hi"),
        F.count_if(F.col(ts).isNotNull() & F.col("_ts").isNull()).alias("n_bad"),
    ).select(F.to_date("lo").alias("min_date"), F.to_date("hi").alias("max_date"),
             whole_days(F.col("hi"), F.col("lo")).alias("days"), "n_bad")


def periods(df: DataFrame, ts: str, freq: str = "D") -> DataFrame:
    """Rows per calendar period: ``period, n``."""
    start = F.date_trunc(PERIODS[freq], _as_time(df, ts))
    period = start if freq == "H" else F.to_date(start)
    return df.select(period.alias("period")).where("period is not null").groupBy("period").agg(
        F.count(F.lit(1)).alias("n"))


def missing_periods(df: DataFrame, ts: str, freq: str = "D") -> DataFrame:
    """Calendar periods between the first and the last one that hold no row."""
    have = periods(df, ts, freq)
    step = F.expr(f"interval 1 {PERIODS[freq]}")
    spine = have.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a is not null").select(
        F.explode(F.sequence("a", "b", step)).alias("period"))
    return spine.join(have, "period", "left_anti")


def volume_cv(df: DataFrame, ts: str, freq: str = "D", limit: float = 0.5) -> DataFrame:
    """``periods, cv, uneven``: coefficient of variation of the rows per present period."""
    return periods(df, ts, freq).agg(
        F.count(F.lit(1)).alias("periods"),
        F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("cv"),
    ).withColumn("uneven", F.col("cv") > limit)


def is_elapsed(df: DataFrame, col: str) -> DataFrame:
    """``is_elapsed``: numeric, and every reading as epoch seconds falls in 1969 or 1970.

    Readings beyond the nanosecond calendar (about year 2262) do not count; if none is left the column is elapsed.
    """
    if not is_numeric(df, col):
        return df.sparkSession.range(1).select(F.lit(False).alias("is_elapsed"))
    year = 365 * 86400
    x = df.select(as_double(df, col).alias("x")).where("x is not null")
    near = F.when(F.abs("x") < 9223372036, F.col("x"))
    return x.agg(F.count("x").alias("n"), F.count(near).alias("k"), F.min(near).alias("lo"), F.max(near).alias("hi")
                 ).select(((F.col("n") > 0) & ((F.col("k") == 0) | ((F.col("lo") >= -year) & (F.col("hi") < year)))
                           ).alias("is_elapsed"))


def elapsed_profile(df: DataFrame, col: str, order: list[str], bins: int = 10) -> DataFrame:
    """``rows, span, reversals, reversal_rate, cv, p01, p25, p50, p75, p99`` of an elapsed-time column.

    Reversals are drops against the row before in the given order; the volume spread runs over equal-width
    right-closed bins, empty ones included.
    """
    x = df.select(*order, as_double(df, col).alias("x")).where("x is not null").withColumn("_all", F.lit(0))

    def drops(frame: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*order)
        return frame.withColumn("drop", (F.col("x") < F.lag("x").over(w)).cast("int"))

    turns = framed(x, "_all", order, drops).agg(F.sum("drop").alias("reversals"), F.count("drop").alias("steps"))
    ends = x.agg(F.count("x").alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.greatest(F.ceil(F.try_divide(F.col("x") - F.col("lo"), width)) - 1, F.lit(0)).cast("int")
    spread = attach(x, ends).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(
        F.sum("n").alias("_n"), F.count("n").alias("_k"), F.avg("n").alias("_avg"), F.var_pop("n").alias("_var"))
    mean = F.col("_n") / bins
    squares = F.col("_k") * (F.col("_var") + (F.col("_avg") - mean) * (F.col("_avg") - mean)) + (bins - F.col("_k")) * mean * mean
    cv = F.sqrt(squares / (bins - 1)) / mean
    marks = quantiles(x, ["x"], [0.01, 0.25, 0.5, 0.75, 0.99]).select(
        *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p01", "p25", "p50", "p75", "p99"))])
    row = ends.select("rows", (F.col("hi") - F.col("lo")).alias("span"))
    row = attach(row, turns.select(F.coalesce("reversals", F.lit(0)).alias("reversals"), F.coalesce(
        F.try_divide("reversals", "steps"), F.lit(0.0)).alias("reversal_rate")))
    return attach(attach(row, spread.select(cv.alias("cv"))), marks)


def _key_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    lk = left.select(F.col(left_key).alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("l"))
    rk = right.select(F.col(right_key).alias("k")).where("k is not null").groupBy("k").agg(
        F.count(F.lit(1)).alias("r"))
    return lk.join(rk, "k", "full_outer")


def linkage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Key coverage and cardinality of a join before it is made, with the number of rows it would give.

    ``l_repeats`` and ``r_repeats`` count rows beyond the first of each key; repeated nulls count like any value.
    """
    keys = _key_counts(left, right, left_key, right_key)
    l, r = F.col("l"), F.col("r")
    sums = keys.agg(
        F.count("l").alias("l_keys"), F.count("r").alias("r_keys"),
        F.count_if(l.isNotNull() & r.isNotNull()).alias("matched"),
        F.count_if(r.isNull()).alias("l_only"), F.count_if(l.isNull()).alias("r_only"),
        F.coalesce(F.sum(l - 1), F.lit(0)).alias("_ld"), F.coalesce(F.sum(r - 1), F.lit(0)).alias("_rd"),
        F.coalesce(F.sum(l.cast("decimal(20,0)") * r), F.lit(0)).cast("bigint").alias("join_rows"),
    )
    nulls = [(left, left_key, "_ln"), (right, right_key, "_rn")]
    for frame, key, out in nulls:
        extra = frame.agg(F.greatest(F.count_if(F.col(key).isNull()) - 1, F.lit(0)))
        sums = sums.withColumn(out, extra.scalar())
    sums = sums.withColumn("l_repeats", F.col("_ld") + F.col("_ln")).withColumn("r_repeats", F.col("_rd") + F.col("_rn"))
    side = {s: F.when(F.col(f"{s}_repeats") > 0, "many").otherwise("one") for s in "lr"}
    return sums.select(
        "l_keys", "r_keys", "matched", "l_only", "r_only",
        F.try_divide("matched", "l_keys").alias("l_rate"), F.try_divide("matched", "r_keys").alias("r_rate"),
        F.concat_ws(":", side["l"], side["r"]).alias("cardinality"), "l_repeats", "r_repeats", "join_rows",
        ((F.col("l_repeats") > 0) & (F.col("r_repeats") > 0)).alias("explodes"),
    )


def join_rows_check(left: DataFrame, right: DataFrame, left_key: str, right_key: str, joined: DataFrame) -> DataFrame:
    """``expected, actual, passed``: rows predicted from the key counts against the rows of the joined table."""
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    want = _key_counts(left, right, left_key, right_key).agg(
        F.coalesce(F.sum(l.cast("decimal(20,0)") * r), F.lit(0)).cast("bigint").alias("expected"))
    return attach(want, joined.agg(F.count(F.lit(1)).alias("actual"))).withColumn(
        "passed", F.col("expected") == F.col("actual"))


def range_check(df: DataFrame, cols: list[str] | None = None, sentinel_rate: float = 0.01) -> DataFrame:
    """Findings ``column, finding, value, n, rate, min, p50, max`` on numeric columns.

    ``outliers``: rows beyond three interquartile ranges (value is the range). ``negative``: a count-like name with
    negative values. ``sentinel``: one placeholder value takes more than ``sentinel_rate`` of the known rows.
    """
    cols = cols or numeric_columns(df)
    marks = {r["column"]: r for r in quantiles(df, cols, [0.25, 0.5, 0.75]).collect()}
    cols = [c for c in cols if c in marks]
    parts = []
    for i in range(0, len(cols), 50):
        block = cols[i:i + 50]
        aggs, rows = [], []
        for k, c in enumerate(block):
            x, m = as_double(df, c), marks[c]
            iqr = m["q2"] - m["q0"]
            low, high = m["q0"] - 3 * iqr, m["q2"] + 3 * iqr
            count_like = any(h in c.lower() for h in COUNT_LIKE)
            aggs += [F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}"), F.count(x).alias(f"n{k}"),
                     F.count_if((x < low) | (x > high)).alias(f"out{k}"), F.count_if(x < 0).alias(f"neg{k}")]
            aggs += [F.count_if(x == s).alias(f"s{k}_{j}") for j, s in enumerate(SENTINELS)]

            def row(kind: str, value: Column, n: str, k=k, c=c, m=m) -> Column:
                return F.struct(
                    F.lit(c).alias("column"), F.lit(kind).alias("finding"), value.cast("double").alias("value"),
                    F.col(n).alias("n"), F.try_divide(F.col(n), F.col(f"n{k}")).alias("rate"),
                    F.col(f"lo{k}").alias("min"), F.lit(m["q1"]).alias("p50"), F.col(f"hi{k}").alias("max"))

            if iqr > 0:
                rows.append(F.when(F.col(f"out{k}") > 0, row("outliers", F.lit(iqr), f"out{k}")))
            if count_like:
                rows.append(F.when(F.col(f"lo{k}") < 0, row("negative", F.col(f"lo{k}"), f"neg{k}")))
            rows += [F.when(F.col(f"s{k}_{j}") > sentinel_rate * F.col(f"n{k}"),
                            row("sentinel", F.lit(s), f"s{k}_{j}")) for j, s in enumerate(SENTINELS)]
        parts.append(exploded(df.agg(*aggs), rows))
    return union_all(parts)


def duplicate_columns(df: DataFrame, key: list[str], cols: list[str] | None = None) -> list[tuple[str, str]]:
    """(column, earlier identical column) pairs, nulls equal to nulls.

    An order-free hash over (row key, value) gives candidates in one pass; a second pass compares only those.
    """
    cols = cols or [c for c in df.columns if c not in key]
    sums = collect_stats(df, [F.bit_xor(F.xxhash64(*key, F.col(c))).alias(c) for c in cols])
    first: dict = {}
    maybe = []
    for c in cols:
        mark = (df.schema[c].dataType.simpleString(), sums[c])
        if mark in first:
            maybe.append((c, first[mark]))
        else:
            first[mark] = c
    if not maybe:
        return []
    same = collect_stats(df, [F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(a) for a, b in maybe])
    return [(a, b) for a, b in maybe if same[a]]


def near_constant(df: DataFrame, cols: list[str] | None = None, limit: float = 0.99) -> DataFrame:
    """``column, top_share, near_constant``: share of the most frequent value, null being one value."""
    found = [(c, top / rows, top >= limit * rows) for c, (rows, top) in top_counts(df, cols or df.columns).items() if rows]
    return df.sparkSession.createDataFrame(found, "column string, top_share double, near_constant boolean")


def task_type(df: DataFrame, target: str, classes: int = 20) -> DataFrame:
    """``task``: classification when the target is no number or has few distinct values, else regression."""
    if not is_numeric(df, target):
        return df.sparkSession.range(1).select(F.lit("classification").alias("task"))
    few = df.select(target).where(~is_null(df, target)).distinct().limit(classes + 1).agg(F.count(F.lit(1)).alias("k"))
    return few.select(F.when(F.col("k") <= classes, "classification").otherwise("regression").alias("task"))


def linkage_density(df: DataFrame, link: str) -> DataFrame:
    return df.agg(F.avg((~is_null(df, link)).cast("int")).alias("density"))


def event_density(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Events per entity: ``entities, mean, std, min, p25, p50, p75, max``."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(ts).alias("n"))
    row = per.agg(F.count(F.lit(1)).alias("entities"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"),
                  F.min("n").alias("min"), F.max("n").alias("max"))
    marks = quantiles(per, ["n"], [0.25, 0.5, 0.75]).select(
        *[F.col(f"q{i}").alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return attach(row, marks)


def window_coverage(df: DataFrame, ts: str, required_days: int) -> DataFrame:
    return df.agg(F.max(ts).alias("hi"), F.min(ts).alias("lo")).select(
        whole_days(F.col("hi"), F.col("lo")).alias("days")).withColumn("passed", F.col("days") >= required_days)


def cohort_size(df: DataFrame, cohort: str, min_members: int = 20) -> DataFrame:
    sizes = df.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("smallest")).withColumn("passed", F.col("smallest") >= min_members)


def corr_matrix(df: DataFrame, cols: list[str] | None = None, high: float = 0.7) -> DataFrame:
    """Correlation of every numeric pair: ``col_a, col_b, r, high``."""
    cols = cols or numeric_columns(df)
    return pair_correlations(df, {c: as_double(df, c) for c in cols}).withColumn("high", F.abs("r") > high)


def class_conditional(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Quantiles of each feature per class: ``class, feature, n, q05, q25, q50, q75, q95``."""
    marks = quantiles(df.where(F.col(target).isNotNull()), features, [0.05, 0.25, 0.5, 0.75, 0.95], [target])
    return marks.select(F.col(target).alias("class"), F.col("column").alias("feature"), "n", *[
        F.col(f"q{i}").alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))])


def class_histogram(df: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram per class over the common range: ``class, bin, n``; the last bin is closed."""
    x = df.select(F.col(target).alias("class"), as_double(df, feature).alias("x")).where(
        "x is not null and class is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    return attach(x, ends).groupBy("class", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
                                   ).agg(F.count(F.lit(1)).alias("n"))


def suppress(df: DataFrame, group: list[str], n_col: str, values: list[str], k: int = 10) -> DataFrame:
    """Keep groups of at least k members and fold all smaller ones into one row counting them.

    ``group…, n, values…, suppressed_groups``; the folded row has NULL group and values.
    """
    small = F.col(n_col) < k
    kept = df.where(~small).select(*group, n_col, *values, F.lit(None).cast("bigint").alias("suppressed_groups"))
    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in group]
    hidden = df.where(small).agg(F.sum(n_col).alias(n_col), F.count(F.lit(1)).alias("suppressed_groups")).where(
        "suppressed_groups > 0").select(
        *none, n_col, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in values], "suppressed_groups")
    return kept.unionByName(hidden)


def pii_scan(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, kind, n_rows, hits`` of personal-data patterns in whole texts."""
    counted = df.select(*[F.regexp_count(F.col(c), F.lit(p)).alias(f"_{i}{k}") for i, c in enumerate(cols)
                          for k, p in PII.items()])
    aggs, rows = [], []
    for i, c in enumerate(cols):
        for kind in PII:
            hits = F.col(f"_{i}{kind}")
            aggs += [F.count_if(hits > 0).alias(f"r{i}{kind}"), F.coalesce(F.sum(hits), F.lit(0)).alias(f"h{i}{kind}")]
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"),
                                 F.col(f"r{i}{kind}").alias("n_rows"), F.col(f"h{i}{kind}").alias("hits")))
    return exploded(counted.agg(*aggs), rows)


def base_rate(df: DataFrame, y: str) -> DataFrame:
    """``rate, majority`` of a 0/1 label: positive rate and the accuracy of always saying the majority."""
    return df.agg(F.avg(y).alias("rate")).withColumn("majority", F.greatest("rate", 1 - F.col("rate")))
