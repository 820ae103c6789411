"""Point-in-time features: what was known about an entity strictly before each decision.

The engine is linear in facts and decisions. Time is cut into blocks as wide as the window, so the window
``[d - w, d)`` is a suffix of one block plus a prefix of the next. Decisions travel through the same sort as the
facts and read both running aggregates; no (fact, decision) pairs are ever made, whatever the number of facts or
decisions of one entity. Facts are merged per timestamp, and an entity with very many is cut further by time (see
``functions.ordering``).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from firmground.functions.columns import DAY_US, join_by, linear_bucket, micros
from firmground.functions.ordering import CHUNK, framed, group_chunks, grouped_running, running, value_counts

_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def window_parts(spine: DataFrame, facts: DataFrame, entity: str, decision: str, ts: str, window_days: float | None,
                 parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """``entity, decision, parts…``: associative aggregates (sum, min, max) of facts in ``[decision - w, decision)``.

    ``window_days=None`` means all history. One row per distinct (entity, decision).
    """
    asks = spine.select(entity, decision).where(F.col(entity).isNotNull()).distinct()
    at = micros(decision)
    rows = facts.where(F.col(entity).isNotNull()).select(
        entity, micros(ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(True).alias("_pre"),
        F.lit(None).cast(spine.schema[decision].dataType).alias(decision), *[c.alias(n) for n, (_, c) in parts.items()])
    empty = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in parts]

    def ask(t: Column, prefix: bool) -> DataFrame:
        return asks.select(entity, t.alias("_t"), F.lit(0).alias("_kind"), F.lit(prefix).alias("_pre"), decision, *empty)

    width = None if window_days is None else int(window_days * DAY_US)
    rows = rows.unionByName(ask(at, True))
    if width:
        rows = rows.unionByName(ask(at - width, False))
    rows = rows.withColumn("_blk", linear_bucket(F.col("_t"), width) if width else F.lit(0).cast("bigint"))
    # facts of one entity at one time are one row, so not even a single timestamp is too large for a chunk
    merged = rows.groupBy(entity, "_t", "_kind", "_pre", decision, "_blk").agg(
        *[_COMBINE[k](n).alias(n) for n, (k, _) in parts.items()])
    rows, cut = group_chunks(merged, entity, "_t", "_cut", judged_by=rows)
    specs = {f"_p_{n}": (k, n) for n, (k, _) in parts.items()}
    run = grouped_running(rows, entity, [entity, "_blk"], ["_t", "_kind"], specs, chunk_col="_cut", cut=cut)
    if not width:
        return run.where("_kind = 0").select(entity, decision, *[F.col(f"_p_{n}").alias(n) for n in parts])
    specs = {f"_s_{n}": (k, n) for n, (k, _) in parts.items()}
    run = grouped_running(run, entity, [entity, "_blk"], ["_t", "_kind"], specs, descending=True, chunk_col="_cut", cut=cut)
    side = [F.when(F.col("_pre"), F.col(f"_p_{n}")).otherwise(F.col(f"_s_{n}")).alias(n) for n in parts]
    return run.where("_kind = 0").select(entity, decision, *side).groupBy(entity, decision).agg(
        *[_COMBINE[k](n).alias(n) for n, (k, _) in parts.items()])


def window_features(spine: DataFrame, facts: DataFrame, entity: str, decision: str, ts: str,
                    window_days: float | None, features: dict[str, tuple[str, Column]], min_rows: int = 1) -> DataFrame:
    """Spine plus features ``{name: (kind, column)}`` with kind count, flag, sum, mean, std, min or max.

    Counts are 0 without facts; the others are NULL under ``min_rows`` known values.
    """
    parts: dict[str, tuple[str, Column]] = {}
    names: dict[tuple, str] = {}
    centres: dict[str, tuple[str, Column]] = {}

    def part(kind: str, col: Column, of: str) -> str:
        """Name of an aggregate, shared by all features that need the same one."""
        name = names.setdefault((kind, of), f"_a{len(names)}")
        parts[name] = (kind, col)
        return name

    outs = []
    for name, (kind, col) in features.items():
        text = str(col)
        if kind in ("count", "flag"):
            is_test = isinstance(facts.select(col).schema[0].dataType, T.BooleanType)
            hit = F.when(col, 1).otherwise(0) if is_test else col.isNotNull().cast("int")
            n = F.coalesce(F.col(part("sum", hit.cast("bigint"), f"hit {text}")), F.lit(0))
            outs.append((n if kind == "count" else n > 0).alias(name))
            continue
        n = F.coalesce(F.col(part("sum", col.isNotNull().cast("bigint"), f"known {text}")), F.lit(0))
        enough = n >= min_rows
        if kind in ("min", "max"):
            value = F.when(enough, F.col(part(kind, col, text)))
        else:
            v = F.col(part("sum", col.cast("double"), text))
            if kind == "sum":
                value = F.when(enough, v)
            elif kind == "mean":
                value = F.when(enough, F.try_divide(v, n))
            else:
                # centred on the entity's own mean: raw sums of squares lose a small spread around a large mean
                centre = centres.setdefault(text, (f"_centre_{len(centres)}", col))[0]
                off = col.cast("double") - F.coalesce(centre, F.lit(0.0))
                v = F.col(part("sum", off, f"off {text}"))
                q = F.col(part("sum", off * off, f"square {text}"))
                spread = F.greatest(q - v * v / F.greatest(n, F.lit(1)), F.lit(0.0))
                value = F.when(enough & (n > 1), F.sqrt(spread / F.greatest(n - 1, F.lit(1))))
        outs.append(value.alias(name))
    if centres:
        means = facts.groupBy(entity).agg(*[F.avg(c.cast("double")).alias(n) for n, c in centres.values()])
        facts = facts.join(means, entity)
    got = window_parts(spine, facts, entity, decision, ts, window_days, parts)
    return spine.join(got.select(entity, decision, *outs), [entity, decision], "left")


def asof(spine: DataFrame, facts: DataFrame, entity: str, decision: str, ts: str, key: str,
         values: list[str]) -> DataFrame:
    """Spine plus the values (and ``<ts>_asof``) of the latest fact before the decision; ties go to the larger key."""
    latest = F.struct(micros(ts).alias("t"), F.col(key).alias("k"), F.col(ts).alias("ts"), *[F.col(v) for v in values])
    got = window_parts(spine, facts, entity, decision, ts, None, {"_last": ("max", latest)})
    flat = got.select(entity, decision, F.col("_last.ts").alias(f"{ts}_asof"), *[
        F.col(f"_last.{v}").alias(v) for v in values])
    return spine.join(flat, [entity, decision], "left")


def first_seen(facts: DataFrame, entity: str, ts: str) -> DataFrame:
    return facts.groupBy(entity).agg(F.min(ts).alias("_first"))


def aggregation(spine, facts, entity, decision, ts, window_days, value: str, min_rows: int = 2) -> DataFrame:
    v = F.col(value)
    return window_features(spine, facts, entity, decision, ts, window_days, {
        f"{value}_mean": ("mean", v), f"{value}_sum": ("sum", v), f"{value}_max": ("max", v),
        f"{value}_std": ("std", v)}, min_rows)


def behavioral(spine, facts, entity, decision, ts, window_days, kind: str, wanted: str) -> DataFrame:
    hit = F.col(kind) == wanted
    return window_features(spine, facts, entity, decision, ts, window_days, {
        f"n_{wanted}": ("count", hit), f"any_{wanted}": ("flag", hit)})


def frequency(spine, facts, entity, decision, ts, window_days) -> DataFrame:
    """``n, exposure_days, rate``: events per day of exposure, exposure being the window or the shorter tenure."""
    counted = window_features(spine, facts, entity, decision, ts, window_days, {"n": ("count", F.col(ts))})
    tenure = (micros(decision) - micros("_first")) / F.lit(float(DAY_US))
    exposure = F.when(tenure > 0, F.least(tenure, F.lit(float(window_days))))
    return counted.join(first_seen(facts, entity, ts), entity, "left").withColumn("exposure_days", exposure).withColumn(
        "rate", F.try_divide("n", "exposure_days")).drop("_first")


def velocity(spine, facts, entity, decision, ts, window_days, value: str) -> DataFrame:
    """``velocity``: change of the mean between two neighbouring windows per day; NULL where either has no value."""
    v = {"_now": ("mean", F.col(value))}
    now = window_features(spine, facts, entity, decision, ts, window_days, v)
    back = F.expr(f"interval {int(window_days)} days")
    shifted = spine.select(entity, (F.col(decision) - back).alias(decision)).distinct()
    before = window_features(shifted, facts, entity, decision, ts, window_days, v).select(
        entity, (F.col(decision) + back).alias(decision), F.col("_now").alias("_before"))
    return now.join(before, [entity, decision], "left").withColumn(
        "velocity", (F.col("_now") - F.col("_before")) / F.lit(float(window_days))).drop("_now", "_before")


def trend(spine, facts, entity, decision, ts, periods: int, value: str, min_periods: int = 5) -> DataFrame:
    """``trend``: slope of the daily mean over the trailing days that ended by the decision; NULL under 5 of them."""
    day = F.floor(micros(ts) / F.lit(float(DAY_US)))
    daily = facts.groupBy(entity, day.alias("_day")).agg(F.avg(value).alias("_y"))
    origin = daily.agg(F.min("_day")).scalar()
    dated = daily.withColumn("_x", (F.col("_day") - origin).cast("double")).withColumn(
        "_end", F.timestamp_micros((F.col("_day") + 1) * F.lit(DAY_US) - 1))
    x, y = F.col("_x"), F.col("_y")
    got = window_parts(spine, dated, entity, decision, "_end", periods, {
        "_n": ("sum", y.isNotNull().cast("bigint")), "_sx": ("sum", x), "_sy": ("sum", y), "_xy": ("sum", x * y),
        "_xx": ("sum", x * x)})
    n = F.col("_n")
    slope = F.try_divide(n * F.col("_xy") - F.col("_sx") * F.col("_sy"), n * F.col("_xx") - F.col("_sx") * F.col("_sx"))
    return spine.join(got.select(entity, decision, F.when(n >= min_periods, slope).alias("trend")),
                      [entity, decision], "left")


def ratio(df: DataFrame, num: str, den: str, out: str, when_zero: float | None = None) -> DataFrame:
    """Ratio with a stated value for a zero denominator (NULL by default); both levels stay."""
    return df.withColumn(out, F.when(F.col(den) == 0, F.lit(when_zero).cast("double")).otherwise(
        F.try_divide(F.col(num).cast("double"), F.col(den))))


def temporal(df: DataFrame, ts: str, anchor: str | None = None) -> DataFrame:
    """``hour, weekday`` (1 = Sunday) and, with an anchor column, ``days_since`` it; the session time zone must be UTC."""
    out = df.withColumns({"hour": F.hour(ts), "weekday": F.dayofweek(ts)})
    return out.withColumn("days_since", F.datediff(ts, anchor)) if anchor else out


def seasonality(df: DataFrame, position: Column, period: float, name: str) -> DataFrame:
    angle = F.lit(2 * math.pi / period) * position
    return df.withColumns({f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)})


def lifetime(spine, facts, entity, decision, ts, new_days: int = 7, dormant_days: int = 30) -> DataFrame:
    """``tenure_days`` since the first fact before the decision, and ``stage``: new, established or dormant."""
    seen = window_parts(spine, facts, entity, decision, ts, None, {
        "_first": ("min", micros(ts)), "_last": ("max", micros(ts))})
    at = micros(decision)
    age = F.floor((at - F.col("_first")) / F.lit(float(DAY_US))).cast("int")
    idle = (at - F.col("_last")) / F.lit(float(DAY_US))
    stage = F.when(F.col("_first").isNull(), None).when(age < new_days, "new").when(
        idle >= dormant_days, "dormant").otherwise("established")
    return spine.join(seen, [entity, decision], "left").withColumns({"tenure_days": age, "stage": stage}).drop(
        "_first", "_last")


def anomaly(facts: DataFrame, entity: str, ts: str, key: str, value: str, rows: int = 10, cold: int = 5) -> DataFrame:
    """``anomaly``: distance of each value from the entity's own previous rows in their standard deviations.

    NULL (unknown, not zero) with fewer than ``cold`` earlier rows or no spread.
    """
    def score(df: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("_at", key).rowsBetween(-rows, -1)
        sd = F.stddev_samp(value).over(w)
        known = (F.count(value).over(w) >= cold) & (sd > 0)
        return df.withColumn("anomaly", F.when(known, (F.col(value) - F.avg(value).over(w)) / sd))

    return framed(facts.withColumn("_at", micros(ts)), entity, ["_at", key], score, back=rows).drop("_at")


def peers(df: DataFrame, cohort: list[str], value: str, min_members: int = 20) -> DataFrame:
    """``peer_rank`` (percent rank) and ``peer_z`` of a point-in-time value in its cohort; NULL in small cohorts.

    ``cohort`` columns include the decision date. Ranks come from chunked counts of distinct values, so a cohort with
    a third of all entities is no single task.
    """
    stats = df.groupBy(*cohort).agg(F.count(value).alias("_m"), F.avg(value).alias("_mu"),
                                    F.stddev_samp(value).alias("_sd"))
    counts = value_counts(df.select(*cohort, value), [value], cohort)
    ranks = running(counts, ["value"], {"_upto": ("sum", "n")}, cohort, chunk_col=CHUNK).select(
        *cohort, F.col("value").alias("_v"), (F.col("_upto") - F.col("n")).alias("_below"))
    x = df.withColumn("_v", F.col(value).cast("double") + 0.0)
    enough = F.col("_m") >= min_members
    return join_by(join_by(x, stats, cohort, "left"), ranks, [*cohort, "_v"], "left").withColumns({
        "peer_rank": F.when(enough, F.try_divide("_below", F.col("_m") - 1)),
        "peer_z": F.when(enough, F.try_divide(F.col("_v") - F.col("_mu"), F.col("_sd"))),
    }).drop("_v", "_m", "_mu", "_sd", "_below")


def transitions(facts: DataFrame, entity: str, ts: str, key: str, kind: str, n: int = 2) -> DataFrame:
    """Every run of n consecutive events of an entity: ``entity, <ts> of the last one, gram``."""
    def chain(df: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("_at", key)
        steps = [F.lag(kind, i).over(w) for i in range(n - 1, 0, -1)] + [F.col(kind)]
        whole = F.lag("_at", n - 1).over(w).isNotNull()
        return df.withColumn("gram", F.when(whole, F.concat_ws(">", *steps)))

    base = facts.where(F.col(kind).isNotNull()).select(entity, ts, key, kind).withColumn("_at", micros(ts))
    return framed(base, entity, ["_at", key], chain, back=n - 1).where("gram is not null").select(entity, ts, "gram")


def sequence(spine, facts, entity, decision, ts, key, kind, grams: list[str], n: int = 2) -> DataFrame:
    """Spine plus one count per named transition completed before the decision."""
    runs = transitions(facts, entity, ts, key, kind, n)
    names = {g: "seq_" + g.replace(">", "_") for g in grams}
    return window_features(spine, runs, entity, decision, ts, None, {
        names[g]: ("count", F.col("gram") == g) for g in grams})


def sharing(spine: DataFrame, edges: DataFrame, entity: str, decision: str, ts: str, key: str, attribute: str,
            outcome: str | None = None) -> DataFrame:
    """``shared_with``: other entities that used, before the decision, the attribute the entity used last.

    With an outcome column on the edges also ``neighbour_rate``: their outcome rate, each entity counting by the
    largest outcome seen on its edges of that attribute so far. Linear in edges: each (attribute, entity) enters a
    running count on first use, and the entity itself is taken off again.
    """
    held = asof(spine.select(entity, decision).distinct(), edges, entity, decision, ts, key, [attribute]).select(
        entity, decision, attribute)
    used = edges.where(F.col(attribute).isNotNull()).groupBy(attribute, entity).agg(F.min(ts).alias(ts))
    asks = held.where(F.col(attribute).isNotNull()).select(attribute, decision)
    n = window_features(asks.distinct(), used, attribute, decision, ts, None, {"_users": ("count", F.col(ts))})
    out = held.join(n, [attribute, decision], "left").withColumn(
        "shared_with", F.when(F.col(attribute).isNull(), 0).otherwise(F.col("_users") - 1))
    keep = ["shared_with"]
    if outcome:
        bad = edges.where((F.col(outcome) == 1) & F.col(attribute).isNotNull()).groupBy(attribute, entity).agg(
            F.min(ts).alias(ts))
        hit = window_features(asks.distinct(), bad, attribute, decision, ts, None, {"_bad": ("count", F.col(ts))})
        own = bad.select(attribute, entity, F.col(ts).alias("_own"))
        out = out.join(hit, [attribute, decision], "left").join(own, [attribute, entity], "left")
        mine = F.when(F.col("_own") < F.col(decision), 1).otherwise(0)
        out = out.withColumn("neighbour_rate", F.try_divide(F.col("_bad") - mine, "shared_with"))
        keep.append("neighbour_rate")
    return spine.join(out.select(entity, decision, *keep), [entity, decision], "left")


def sharing_union(spine: DataFrame, edges: DataFrame, entity: str, decision: str, ts: str, attributes: list[str],
                  hub: int = 50, outcome: str | None = None) -> DataFrame:
    """``shared_with``: other entities that, before the decision, had used a value of any attribute the entity had used.

    A value used by more than ``hub`` entities before the decision is a hub, such as a shared employer, and links nobody
    from then on. With an outcome column on the edges also ``neighbour_rate``: the share of them with an outcome of 1 on any
    edge before the decision.

    Only first uses matter, and of a value only those of its first ``hub`` entities. Each pair among them is linked from the
    later first use until the value becomes a hub; the union of a pair's spans turns into +1 and -1 at their ends, which
    one running sum reads at all decisions. Pairs are bounded by ``hub`` per use and are not repeated per decision.
    """
    used = None
    for a in attributes:
        part = edges.where(F.col(entity).isNotNull() & F.col(a).isNotNull()).groupBy(entity, F.col(a).cast("string").alias("_value")).agg(F.min(ts).alias("_from"))
        part = part.withColumn("_attribute", F.lit(a))
        used = part if used is None else used.unionByName(part)
    order = Window.partitionBy("_attribute", "_value").orderBy("_from", entity)
    first = used.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= hub + 1)
    until = first.withColumn("_until", F.max(F.when(F.col("_turn") == hub + 1, F.col("_from"))).over(Window.partitionBy("_attribute", "_value")))
    until = until.where(F.col("_turn") <= hub)
    other = until.select("_attribute", "_value", F.col(entity).alias("_other"), F.col("_from").alias("_other_from"))
    spans = until.join(other, ["_attribute", "_value"]).where(F.col(entity) != F.col("_other")).select(
        entity, "_other", F.greatest("_from", "_other_from").alias("_start"), "_until").where("_until is null or _start < _until")
    # the union of the spans of a pair; a pair has at most one per value
    last = F.lit("9999-12-31").cast(edges.schema[ts].dataType)
    w = Window.partitionBy(entity, "_other").orderBy("_start", "_end")
    spans = spans.withColumn("_end", F.coalesce("_until", last))
    spans = spans.withColumn("_reach", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_island", F.count_if(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach"))).over(w))
    links = spans.groupBy(entity, "_other", "_island").agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
    if outcome:
        bad = edges.where(F.col(outcome) == 1).groupBy(F.col(entity).alias("_other")).agg(F.min(ts).alias("_bad"))
        links = links.join(bad, "_other", "left")
    else:
        links = links.withColumn("_bad", F.lit(None).cast(edges.schema[ts].dataType))
    since = F.greatest("_start", "_bad")  # null without an outcome: greatest skips nulls, so it is asked for below
    worse = F.col("_bad").isNotNull() & (since < F.col("_end"))
    one, none = F.lit(1), F.lit(0)

    def mark(at: Column, n: Column, b: Column) -> Column:
        return F.struct(at.alias("_at"), n.alias("_n"), b.alias("_b"))

    marks = F.array(mark(F.col("_start"), one, none), F.when(worse, mark(since, none, one)),
                    F.when(F.col("_end") < last, mark(F.col("_end"), -one, F.when(worse, -one).otherwise(none))))
    facts = links.select(entity, F.explode(F.array_compact(marks)).alias("m")).select(entity, "m.*").groupBy(entity, "_at").agg(
        F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
    got = window_features(spine.select(entity, decision).distinct(), facts, entity, decision, "_at", None,
                          {"_n": ("sum", F.col("_n")), "_b": ("sum", F.col("_b"))})
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    keep = [n.alias("shared_with")] + ([F.try_divide("_b", n).alias("neighbour_rate")] if outcome else [])
    return spine.join(got.select(entity, decision, *keep), [entity, decision], "left")


def interaction(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(a) * F.col(b))


def business_rule(spine, facts, entity, decision, ts, rule: str, condition: Column, window_days: float,
                  at_least: int) -> DataFrame:
    """``<rule>_n`` and ``<rule>``: whether the stated condition held at least so often inside the window."""
    counted = window_features(spine, facts, entity, decision, ts, window_days, {f"{rule}_n": ("count", condition)})
    return counted.withColumn(rule, F.col(f"{rule}_n") >= at_least)
