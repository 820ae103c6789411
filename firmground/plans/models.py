"""Baseline, forecast and model-selection queries."""
from pyspark.sql import functions as F

from firmground.operators import baselines as B, champion as C, metrics as M, splits as S
from firmground.operators.audit import periods
from firmground.plans.registry import query
from firmground.plans.scored import PRED, predictions
from firmground.plans.scores import rounded

CUT = "timestamp '1999-09-01'"
TT = f"""x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, case when l_returnflag = 'R' then 1 else 0 end as y, l_quantity,
 case when l_linenumber % 5 = 0 then null else l_extendedprice end as price, case when l_suppkey % 9 = 0 then null else l_linestatus end as status from lineitem),
tr as (select * from x where l_shipdate < {CUT}), te as (select * from x where l_shipdate >= {CUT})"""


def halves(t):
    x = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        "l_quantity", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_linestatus")).alias("status"))
    late = F.col("l_shipdate") >= F.to_timestamp(F.lit("1999-09-01"))
    return x.where(~late), x.where(late)


@query("bl01_encode", f"""with {TT}, m as (select quantile_cont(price, 0.5) as m from tr)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(price, m), 4) as price,
  case coalesce(status, '__missing__') when 'F' then 0.0::double when 'O' then 1.0::double else 2.0::double end as status from te, m""")
def _(t):
    _, b = B.encode(*halves(t), ["price", "status"])
    return rounded(b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "status"), "price", n=4)


@query("bl02_trivial", f"""with {TT}
select 'average_precision' as metric, round(avg(y), 6) as score from tr union all select 'roc_auc', 0.5 union all select 'f1', 0.0
union all select 'neg_rmse', round(-stddev_pop(y), 6) from te""")
def _(t):
    a, b = halves(t)
    out = None
    for m in ("average_precision", "roc_auc", "f1", "neg_rmse"):
        row = B.trivial(a, b, "y", m).select(F.lit(m).alias("metric"), "score")
        out = row if out is None else out.unionByName(row)
    return rounded(out, "score")


@query("bl03_mean_predictor", f"""with {TT} select round(-sqrt(avg((l_quantity - (select avg(l_quantity) from tr)) ** 2)), 6) as score from te""")
def _(t):
    return rounded(B.mean_predictor(*halves(t), "l_quantity"), "score")


@query("bl04_last_value", f"""with {TT}, l as (select l_quantity as v from tr order by l_shipdate desc, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 10000 + l_suppkey desc limit 1)
select round(-sqrt(avg((l_quantity - (select v from l)) ** 2)), 6) as score from te""")
def _(t):
    a, b = (x.withColumn("row", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")) for x in halves(t))
    return rounded(B.last_value(a, b, "l_quantity", "l_shipdate", "row"), "score")


@query("bl05_logistic")
def _(t):
    a, b = B.encode(*halves(t), ["l_quantity", "price", "status"])
    return M.auc(B.logistic(a, b, "y", ["l_quantity", "price", "status"], balanced=True), "_label", "_p")


@query("bl06_boosted")
def _(t):
    a, b = B.encode(*halves(t), ["l_quantity", "price", "status"])
    return M.auc(B.boosted(a, b, "y", ["l_quantity", "price", "status"], trees=100, counted=True), "_label", "_p", weight="_weight")


@query("bl07_ridge", f"""with {TT}, s as (select avg(l_quantity) as mx, avg(y) as my, regr_sxx(y, l_quantity) as sxx, regr_sxy(y, l_quantity) as sxy from tr),
c as (select sxy / (sxx + 1000) as w, my - sxy / (sxx + 1000) * mx as b from s)
select 'neg_rmse' as metric, round(-sqrt(avg((y - (b + w * l_quantity)) ** 2)), 6) as value, count(*) as n from te, c""")
def _(t):
    a, b = halves(t)
    return rounded(M.neg_rmse(B.ridge(a, b, "y", ["l_quantity"], 1000.0), "_label", "_p"), "value")


@query("bl08_rule", f"""with {TT} select round(2.0 * count(*) filter (l_quantity > 40 and y = 1) / (2.0 * count(*) filter (l_quantity > 40 and y = 1)
  + count(*) filter (l_quantity > 40 and y = 0) + count(*) filter (l_quantity <= 40 and y = 1)), 6) as score from te""")
def _(t):
    return rounded(B.rule(halves(t)[1], "y", F.when(F.col("l_quantity") > 40, 1.0).otherwise(0.0), "f1"), "score")


SERIES = """s as (select o_orderpriority as series, date_trunc('month', o_orderdate)::date as period, count(*)::double as y from orders group by all)"""


def series(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("y"))


@query("bl09_seasonal_naive", f"""with {SERIES} select series, period, y, lag(y) over w as last_value, lag(y, 12) over w as seasonal_naive
from s window w as (partition by series order by period)""")
def _(t):
    return B.seasonal_naive(series(t), "series", "period", "y", 12)


@query("bl10_bar_to_beat", f"""with {TT}, p as (select 'mean' as baseline, -sqrt(avg((l_quantity - (select avg(l_quantity) from tr)) ** 2)) as score from te
 union all select 'last_value', -sqrt(avg((l_quantity - (select l_quantity from tr order by l_shipdate desc, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 10000 + l_suppkey desc limit 1)) ** 2)) from te)
select baseline, 'neg_rmse' as metric, round(score, 6) as score, score = max(score) over () as is_bar from p""")
def _(t):
    a, b = (x.withColumn("row", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")) for x in halves(t))
    rows = B.mean_predictor(a, b, "l_quantity").select(F.lit("mean").alias("baseline"), F.lit("neg_rmse").alias("metric"), "score").unionByName(
        B.last_value(a, b, "l_quantity", "l_shipdate", "row").select(F.lit("last_value").alias("baseline"), F.lit("neg_rmse").alias("metric"), "score"))
    return rounded(B.with_bar(rows), "score")


@query("bl10_baseline_table")
def _(t):
    return B.baselines(*halves(t), "y", ["l_quantity", "price", "status"], "average_precision", trees=100)


BACK = f"""{SERIES}, i as (select period, row_number() over (order by period) - 1 as i from (select distinct period from s)),
f as (select unnest(range(1, (select ((count(*) - 24) // 6 + 1)::bigint from i))) as fold),
v as (select series, i, y from s join i using (period)),
t as (select fold, v.series, v.i, v.y, 23 + (fold - 1) * 6 as e from f join v on v.i >= 24 + (fold - 1) * 6 and v.i < 24 + fold * 6),
p as (select t.*, 'last_value' as model, e as at from t union all select t.*, 'seasonal_naive', e - 12 + 1 + (i - e - 1) % 12 from t),
sc as (select p.series, model, fold, -avg(abs(p.y - v.y)) as score from p join v on v.series = p.series and v.i = p.at group by all)"""


def scores(t):
    folds = S.walk_forward(periods(t.orders, "o_orderdate", "M"), "period", 24, 6)
    return B.backtest(series(t), folds, "series", "period", "y", 12)


@query("bl11_backtest", f"""with {BACK} select series, model, count(*) as folds, round(avg(score), 6) as mean,
  round(stddev_samp(score) / sqrt(count(*)), 6) as se from sc group by all""")
def _(t):
    return rounded(M.fold_stats(scores(t), "score", ["series", "model"]), "mean", "se")


@query("bl12_unit_root", f"""with {SERIES}, d as (select series, y - lag(y) over w as d, lag(y) over w as x from s window w as (partition by series order by period)),
g as (select series, count(*) as n, regr_slope(d, x) as b, regr_sxx(d, x) as sxx, regr_syy(d, x) as syy, regr_sxy(d, x) as sxy from d where x is not null group by 1)
select series, n, round(b, 6) as slope, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 4) as t, b / sqrt((syy - b * sxy) / (n - 2) / sxx) < -2.86 as stationary from g""")
def _(t):
    return rounded(rounded(B.unit_root(series(t), "series", "period", "y"), "slope"), "t", n=4)


@query("bl13_leftover_season", f"""with {SERIES}, d as (select series, month(period)::int as position, y - lag(y, 12) over (partition by series order by period) as r from s)
select series, position, count(*) as n, round(avg(r), 6) as residual from d where r is not null group by all""")
def _(t):
    return rounded(B.leftover_season(series(t), "series", "period", "y", 12, F.month("period")), "residual")


EXP = f"""{PRED}, fs as (select channel as grp, 'tree' as name, 'GradientBoostingClassifier' as model_type, l_suppkey % 5 as fold, -avg(abs(y - p)) as s from pred group by all
 union all select channel, 'linear', 'LogisticRegression', l_suppkey % 5, -avg(abs(y - (p * 0.999 + 0.0005))) from pred group by all
 union all select channel, 'other', 'MLPClassifier', l_suppkey % 5, -avg(abs(y - p_base)) from pred group by all),
e as (select grp, name, model_type, avg(s) as metric_value, stddev_samp(s) / sqrt(count(*)) as se,
  case model_type when 'LogisticRegression' then 2 when 'GradientBoostingClassifier' then 5 else 6 end as complexity from fs group by all)"""


def experiments(t):
    p = predictions(t.lineitem).withColumn("p_lin", F.col("p") * 0.999 + 0.0005)
    parts = None
    for name, kind, col in (("tree", "GradientBoostingClassifier", "p"), ("linear", "LogisticRegression", "p_lin"), ("other", "MLPClassifier", "p_base")):
        one = p.groupBy(F.col("channel").alias("grp"), (F.col("l_suppkey") % 5).alias("fold")).agg((-F.avg(F.abs(F.col("y") - F.col(col)))).alias("s")).select(
            "grp", F.lit(name).alias("name"), F.lit(kind).alias("model_type"), "fold", "s")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("grp", "name", "model_type").agg(
        F.avg("s").alias("metric_value"), F.transform(F.array_sort(F.collect_list(F.struct("fold", "s"))), lambda x: x["s"]).alias("fold_scores")).withColumns(
        {"contract_hash": F.when(F.col("name") != "nothing", F.lit("c1")), "metric_name": F.lit("neg_mae")})


@query("ch01_champion", f"""with {EXP}, b as (select grp, arg_max(se, metric_value) as se, max(metric_value) as top, count(*) as total from e group by 1),
n as (select e.*, b.se as bse, b.total, count(*) over (partition by e.grp) as k from e join b on b.grp = e.grp and e.metric_value >= top - b.se)
select grp, name, model_type, round(metric_value, 6) as metric_value, round(bse, 6) as se, k as within_1se, total, 0::bigint as metric_mismatches
from n qualify row_number() over (partition by grp order by complexity, metric_value desc) = 1""")
def _(t):
    return rounded(C.champion(experiments(t), "grp", True, "c1", "neg_mae"), "metric_value", "se")


@query("ch02_pareto_front", f"""with {EXP}, r as (select *, min(complexity) over (partition by grp order by metric_value desc, complexity rows between unbounded preceding and 1 preceding) as m from e)
select grp, name, complexity, round(metric_value, 6) as metric_value from r where m is null or complexity < m""")
def _(t):
    return rounded(C.pareto(experiments(t), "grp"), "metric_value")


@query("ch03_se_floor", f"""with {EXP}, r as (select *, row_number() over (partition by grp order by metric_value desc) as k from e),
g as (select grp, max(metric_value) filter (k = 1) - max(metric_value) filter (k = 2) as gap, max(se) filter (k = 1) as se from r group by 1)
select grp, round(gap, 6) as gap, round(se, 6) as se, gap >= 0.5 * se as "continue" from g""")
def _(t):
    return rounded(C.se_floor(experiments(t), "grp"), "gap", "se")
