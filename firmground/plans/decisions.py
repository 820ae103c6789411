"""Calibration, threshold, slice and fairness queries on the prediction table."""
from pyspark.sql import functions as F

from firmground.operators import calibrate as C, decide as D, errors as E
from firmground.plans.registry import query
from firmground.plans.scored import KEY, PRED, predictions
from firmground.plans.scores import GLOBAL_CURVE, rounded

EDGES = [i * 0.1 for i in range(10)]
BIN = " + ".join(f"(p >= {e!r}::double)::int" for e in EDGES[1:])
BINS = "with " + PRED + f""", b as (select ({BIN})::int as bin, avg(p) as pm, avg(y) as om, count(*) as n from pred group by 1)"""


@query("ca01_reliability", BINS + """
select bin, round((bin * 2 + 1) / 20.0::double, 6) as center, round(pm, 6) as predicted, round(om, 6) as observed, n as "count" from b""")
def _(t):
    return rounded(C.reliability(predictions(t.lineitem), "y", "p"), "center", "predicted", "observed")


@query("ca02_calibration_summary", BINS + """
, s as (select sum(n * abs(om - pm)) / sum(n) as ece, max(abs(om - pm)) as mx, count(*) as k from b)
select round(ece, 6) as ece, round(mx, 6) as max_ce, round((select avg((p - y) ** 2) from pred), 6) as brier, k as bins_used,
  case when ece < 0.02 and mx < 0.05 then 'well-calibrated' when ece < 0.05 and mx < 0.10 then 'acceptable'
       when ece < 0.10 then 'poor' else 'severe' end as verdict from s""")
def _(t):
    return rounded(C.calibration_summary(predictions(t.lineitem), "y", "p"), "ece", "max_ce", "brier")


def halves(t):
    p = predictions(t.lineitem)
    early = F.col("ts") < F.to_timestamp(F.lit("1999-01-01"))
    return p.where(early), p.where(~early)


@query("ca03_platt")
def _(t):
    fit, rest = halves(t)
    done = C.platt_fit(fit, "y", "p").apply(rest, "p", "p_cal")
    return C.reliability(done, "y", "p_cal")


EARLY = "ts < timestamp '1999-01-01'"


@query("ca04_isotonic", "with " + PRED + f""", c as (select p, sum(y) as pos, count(*) as n, row_number() over (order by p) as i from pred where {EARLY} group by p),
s as (select *, sum(pos) over (order by p) as up, sum(n) over (order by p) as un from c),
pairs as (select a.i as j, b.i as k, (b.up - a.up + a.pos) / (b.un - a.un + a.n)::double as v from s a join s b on a.i <= b.i),
low as (select j, k, min(v) over (partition by j order by k desc) as v from pairs),
fit as (select s.p, max(low.v) as v from low join s on s.i = low.k group by s.p),
rest as (select y, p from pred where not ({EARLY})),
told as (select r.y, case when a.p is null then b.v when b.p is null or a.p = b.p then a.v else a.v + (r.p - a.p) / (b.p - a.p) * (b.v - a.v) end as q
  from rest r asof left join fit a on r.p >= a.p asof left join fit b on r.p <= b.p),
g as (select least(floor(round(q, 9) * 10), 9)::int as bin, avg(q) as predicted, avg(y) as observed, count(*) as n from told group by 1)
select bin, round((bin * 2 + 1) / 20.0::double, 6) as center, round(predicted, 6) as predicted, round(observed, 6) as observed, n as "count" from g""")
def _(t):
    fit, rest = halves(t)
    done = C.isotonic_fit(fit, "y", "p").apply(rest, "p", "p_cal")
    return rounded(C.reliability(done, "y", "p_cal"), "center", "predicted", "observed")


@query("ca05_rank_check", GLOBAL_CURVE + """
, a as (select sum(pos * tp / (tp + fp)::double) / sum(pos) as ap from r)
select round(ap, 6) as ap_before, round(ap, 6) as ap_after, 0.0::double as delta, true as rank_kept, true as in_range from a""")
def _(t):
    p = predictions(t.lineitem).withColumn("p_cal", 1 / (1 + F.exp(-(F.col("p") * 3 - 2))))
    return rounded(C.rank_check(p, "y", "p", "p_cal"), "ap_before", "ap_after", "delta")


COST = {"tp": 10.0, "fp": -2.0, "fn": -8.0, "tn": 0.5}
SWEEP = "with " + PRED + """, e as (select min(p) as lo, max(p) as hi from pred),
g as (select i, case when i = 99 then hi else lo + i * ((hi - lo) / 99) end as t from e, (select unnest(range(100)) as i)),
s as (select t, count(*) filter (p >= t and y = 1) as tp, count(*) filter (p >= t and y = 0) as fp,
  count(*) filter (p < t and y = 1) as fn, count(*) filter (p < t and y = 0) as tn from g, pred group by t),
w as (select *, tp * 10.0::double - fp * 2.0::double - fn * 8.0::double + tn * 0.5::double as ev, tp + fp as flagged from s)"""


@query("dc01_threshold_sweep", SWEEP + """
select round(t, 6) as t, tp, fp, fn, tn, round(ev, 4) as ev, flagged from w""")
def _(t):
    s = D.threshold_sweep(predictions(t.lineitem), "y", "p", COST)
    return rounded(rounded(s, "t"), "ev", n=4)


CHOICE = """, c as (select * from w where flagged <= 9000),
b as (select t as ev_t, ev from w order by ev desc, t limit 1)
select round(ev_t, 6) as ev_t, round(ev, 4) as ev, round((select max(t) from c), 6) as cap_t_high,
  (select flagged from c order by t desc limit 1) as flagged_high, round((select min(t) from c), 6) as cap_t_low,
  (select flagged from c order by t limit 1) as flagged_low, abs(ev_t - (select max(t) from c)) < 1e-6 as agree from b"""


@query("dc02_best_threshold", SWEEP + "select round(t, 6) as ev_t, round(ev, 4) as ev from w order by w.ev desc, w.t limit 1")
def _(t):
    best = D.choose(D.threshold_sweep(predictions(t.lineitem), "y", "p", COST)).select("ev_t", "ev")
    return rounded(rounded(best, "ev_t"), "ev", n=4)


@query("dc03_capacity_threshold", SWEEP + CHOICE)
def _(t):
    c = D.choose(D.threshold_sweep(predictions(t.lineitem), "y", "p", COST), 9000)
    return rounded(rounded(c, "ev_t", "cap_t_high", "cap_t_low"), "ev", n=4)


BANDS = [(0.0, "pass"), (0.4, "review"), (0.7, "block")]


@query("dc04_score_bands", "with " + PRED + """
, b as (select case when p >= 0.7 then 'block' when p >= 0.4 then 'review' else 'pass' end as band, y from pred)
select band, count(*) as n, round(count(*) / (select count(*) from b)::double, 6) as share, round(avg(y), 6) as observed,
  case band when 'block' then sum(y) * 9.0::double + sum(1 - y) * -4.0::double when 'review' then sum(y) * 5.0::double + sum(1 - y) * -1.0::double
  else sum(y) * -8.0::double end as ev from b group by band""")
def _(t):
    gain = {"block": (9.0, -4.0), "review": (5.0, -1.0), "pass": (-8.0, 0.0)}
    return rounded(D.score_bands(predictions(t.lineitem), "y", "p", BANDS, gain), "share", "observed")


@query("dc05_overrides", "with " + PRED + """
, d as (select case when p >= 0.7 then 'block' when p >= 0.4 then 'review' else 'pass' end as band, (p >= 0.4)::int as m,
  case when l_partkey % 9 = 0 then 1 - (p >= 0.4)::int else (p >= 0.4)::int end as h from pred)
select band, count(*) as n, round(avg((h = 1 and m = 0)::int), 6) as up_rate, round(avg((h = 0 and m = 1)::int), 6) as down_rate,
  round(avg((h <> m)::int), 6) as override_rate from d group by band""")
def _(t):
    p = predictions(t.lineitem).withColumn("band", D.band_of("p", BANDS)).withColumn(
        "m", (F.col("p") >= 0.4).cast("int"))
    p = p.withColumn("h", F.when(F.col("l_partkey") % 9 == 0, 1 - F.col("m")).otherwise(F.col("m")))
    return rounded(D.overrides(p, "m", "h", "band"), "up_rate", "down_rate", "override_rate")


HARD = PRED + ", h as (select *, (p > 0.5)::int as pred_y, channel || l_linenumber as lane from pred)"


def hard(t):
    return predictions(t.lineitem).withColumn("pred_y", (F.col("p") > 0.5).cast("int")).withColumn(
        "lane", F.concat("channel", "l_linenumber"))


@query("dc06_confusion", "with " + HARD + """
, w as (select lane from h group by lane order by avg((y <> pred_y)::int) desc, lane limit 1)
select null as slice, y, pred_y as pred, count(*) as n from h group by all union all
select lane, y, pred_y, count(*) from h where lane = (select lane from w) group by all""")
def _(t):
    return D.confusion(hard(t), "y", "pred_y", "lane")


@query("er01_overall_error", "with " + HARD + """
select 'error_rate' as metric, round(avg((y <> pred_y)::int), 6) as value, count(*) as n from h
union all select 'mae', round(avg(abs(qty - (price / 1500))), 6), count(*) from h""")
def _(t):
    h = hard(t)
    guess = h.withColumn("guess", F.col("price") / 1500)
    return rounded(E.overall_error(h, "y", "pred_y").unionByName(E.overall_error(guess, "qty", "guess")), "value")


SLICES = """u as (select 'segment' as "column", segment as value, e from x union all select 'lane', lane, e from x
  union all select 'brand', brand, e from x where brand is not null)"""


@query("er02_slice_errors", "with " + HARD + """
, x as (select (y <> pred_y)::int::double as e, segment, lane, case when l_suppkey % 8 = 0 then null else (l_suppkey % 8)::varchar end as brand from h),
""" + SLICES + """, t as (select count(*) as tn, sum(e) as ts from x),
g as (select "column", value, count(*) as n, sum(e) as s from u group by all),
r as (select *, s / n as p1, (ts - s) / (tn - n) as p2, ts / tn as pp, tn - n as m from g, t where n >= 30)
select "column", value, n, round(p1, 6) as rate, round(p2, 6) as rest_rate,
  round((p1 - p2) / sqrt(pp * (1 - pp) * (1.0::double / n + 1.0::double / m)), 4) as stat,
  p1 > p2 and (p1 - p2) / sqrt(pp * (1 - pp) * (1.0::double / n + 1.0::double / m)) > 1.9599639845400545 as flag from r""")
def _(t):
    h = hard(t).withColumn("brand", F.when(F.col("l_suppkey") % 8 != 0, F.col("l_suppkey") % 8))
    s = E.slice_errors(h, "y", "pred_y", ["segment", "lane", "brand"])
    return rounded(rounded(s, "rate", "rest_rate"), "stat", n=4).drop("p", "df")


@query("er02_flagged_slices", "with " + HARD + """
, x as (select (y <> pred_y)::int::double as e, segment, lane, channel as brand from h),
""" + SLICES.replace("'brand'", "'channel'") + """, t as (select count(*) as tn, sum(e) as ts from x),
g as (select "column", value, count(*) as n, sum(e) as s from u group by all),
r as (select *, s / n as p1, (ts - s) / (tn - n) as p2, ts / tn as pp, tn - n as m from g, t where n >= 30),
z as (select "column", value, n, round(p1, 6) as rate, round(p2, 6) as rest_rate,
  (p1 - p2) / sqrt(pp * (1 - pp) * (1.0::double / n + 1.0::double / m)) as z from r)
select "column", value, n, rate, rest_rate, round(z, 4) as stat, true as flag from z where z > 1.9599639845400545 order by z desc limit 10""")
def _(t):
    s = E.flagged_slices(E.slice_errors(hard(t), "y", "pred_y", ["segment", "lane", "channel"]))
    return rounded(rounded(s, "rate", "rest_rate"), "stat", n=4).drop("p", "df")


@query("er03_slice_errors_regression", "with " + HARD + """
, x as (select abs(qty - price / 1500) as e, segment, lane, null as brand from h),
""" + SLICES + """, g as (select "column", value, count(*) as n, avg(e) as m, var_samp(e) as v from u group by all),
rest as (select g."column", g.value, count(*) as n2, avg(u.e) as m2, var_samp(u.e) as v2 from g join u on u."column" = g."column" and u.value <> g.value group by all),
r as (select *, v / n as a, v2 / n2 as b from g join rest using ("column", value) where n >= 30)
select "column", value, n, round(m, 6) as rate, round(m2, 6) as rest_rate, round((m - m2) / sqrt(a + b), 4) as stat,
  round((a + b) ** 2 / (a * a / (n - 1) + b * b / (n2 - 1)), 2) as df from r""")
def _(t):
    h = hard(t).withColumn("guess", F.col("price") / 1500)
    s = E.slice_errors(h, "qty", "guess", ["segment", "lane"], "mae")
    return rounded(rounded(rounded(s, "rate", "rest_rate"), "stat", n=4), "df", n=2).drop("p", "flag")


@query("er04_residual_bias", "with " + PRED + """
select segment as slice, count(*) as n, round(avg(p - y), 6) as bias, round(avg((p > y)::int), 6) as over_share from pred group by 1""")
def _(t):
    return rounded(E.residual_bias(predictions(t.lineitem), "y", "p", "segment"), "bias", "over_share")


@query("er05_worst_rows", "with " + PRED + """
, h as (select *, case when l_linenumber = 3 then null else qty end as q2, case when l_partkey % 400 = 0 then price * 40 else price end as pr2 from pred),
f as (select quantile_cont(q2, [0.25, 0.75]) as a, quantile_cont(pr2, [0.25, 0.75]) as b from h)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y, p, round(abs(y - p), 6) as error, (q2 is null)::int as null_inputs,
  (coalesce(q2 not between a[1] - 3 * (a[2] - a[1]) and a[2] + 3 * (a[2] - a[1]), false)::int
   + (pr2 not between b[1] - 3 * (b[2] - b[1]) and b[2] + 3 * (b[2] - b[1]))::int) as range_flags
from h, f order by abs(y - p) desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 50""")
def _(t):
    h = predictions(t.lineitem).withColumn("q2", F.when(F.col("l_linenumber") != 3, F.col("qty"))).withColumn(
        "pr2", F.when(F.col("l_partkey") % 400 == 0, F.col("price") * 40).otherwise(F.col("price")))
    return rounded(E.worst_rows(h, "y", "p", KEY, ["q2", "pr2"]), "error")


@query("er06_fairness", "with " + HARD + """
, g as (select lane as grp, count(*) as n, avg((y <> pred_y)::int) as e,
  count(*) filter (pred_y = 1 and y = 0) / count(*) filter (y = 0)::double as f,
  count(*) filter (pred_y = 0 and y = 1) / count(*) filter (y = 1)::double as m, avg(pred_y) as s from h group by 1)
select grp, n, round(e, 6) as error_rate, round(f, 6) as fpr, round(m, 6) as fnr, round(s, 6) as selection_rate,
  round(e - min(e) over (), 6) as error_gap, round(f - min(f) over (), 6) as fpr_gap, round(m - min(m) over (), 6) as fnr_gap,
  round(max(s) over () - s, 6) as selection_gap from g""")
def _(t):
    return rounded(E.fairness(hard(t), "y", "pred_y", "lane"), "error_rate", "fpr", "fnr", "selection_rate",
                   "error_gap", "fpr_gap", "fnr_gap", "selection_gap")
