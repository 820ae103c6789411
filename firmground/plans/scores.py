"""Metric queries on the prediction table."""
from pyspark.sql import functions as F

from firmground.operators import metrics as M
from firmground.plans.registry import query
from firmground.plans.scored import KEY, PRED, predictions

AUC = """
, c as (select {g} p as score, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from pred group by all),
r as (select *, sum(pos) over ({part} order by score desc) as tp, sum(neg) over ({part} order by score desc) as fp,
             sum(neg) over ({part} order by score) - neg as nb from c)"""
GLOBAL_CURVE = "with " + PRED + AUC.format(g="", part="")
SEGMENT_CURVE = "with " + PRED + AUC.format(g="segment,", part="partition by segment")


def rounded(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


@query("mx01_roc_auc", GLOBAL_CURVE + """
select 'roc_auc' as metric, round(sum(pos::double * (nb + neg / 2.0)) / (sum(pos)::double * sum(neg)), 6) as value,
       sum(pos + neg)::bigint as n from r""")
def _(t):
    return rounded(M.auc(predictions(t.lineitem), "y", "p"), "value")


@query("mx02_average_precision", GLOBAL_CURVE + """
select 'average_precision' as metric, round(sum(pos * tp / (tp + fp)::double) / sum(pos), 6) as value,
       sum(pos + neg)::bigint as n from r""")
def _(t):
    return rounded(M.average_precision(predictions(t.lineitem), "y", "p"), "value")


@query("mx03_f1", "with " + PRED + """
select 'f1' as metric, round(2.0 * count(*) filter (p > 0.5 and y = 1) /
  (2.0 * count(*) filter (p > 0.5 and y = 1) + count(*) filter (p > 0.5 and y = 0)
   + count(*) filter (p <= 0.5 and y = 1)), 6) as value, count(*) as n from pred""")
def _(t):
    return rounded(M.f1(predictions(t.lineitem), "y", "p"), "value")


@query("mx04_accuracy", "with " + PRED + """
select 'accuracy' as metric, round(avg(case when y = round_even(p, 0) then 1 else 0 end), 6) as value,
       count(*) as n from pred""")
def _(t):
    return rounded(M.accuracy(predictions(t.lineitem), "y", "p"), "value")


@query("mx05_precision_recall", "with " + PRED + """
select round(count(*) filter (p >= 0.6 and y = 1) / count(*) filter (p >= 0.6)::double, 6) as precision,
       round(count(*) filter (p >= 0.6 and y = 1) / count(*) filter (y = 1)::double, 6) as recall,
       count(*) filter (p >= 0.6) as flagged from pred""")
def _(t):
    return rounded(M.precision_recall(predictions(t.lineitem), "y", "p", 0.6), "precision", "recall")


@query("mx06_precision_at_k", "with " + PRED + """
select 'precision_at_500' as metric, round(avg(y), 6) as value, count(*) as n from
 (select y from pred order by p desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500)""")
def _(t):
    return rounded(M.precision_at_k(predictions(t.lineitem), "y", "p", KEY, 500), "value")


@query("mx07_neg_mae", "with " + PRED + """
select 'neg_mae' as metric, round(-avg(abs(y - p)), 6) as value, count(*) as n from pred""")
def _(t):
    return rounded(M.neg_mae(predictions(t.lineitem), "y", "p"), "value")


@query("mx08_neg_rmse", "with " + PRED + """
select 'neg_rmse' as metric, round(-sqrt(avg((y - p) ** 2)), 6) as value, count(*) as n from pred""")
def _(t):
    return rounded(M.neg_rmse(predictions(t.lineitem), "y", "p"), "value")


@query("mx09_brier", "with " + PRED + """
select 'brier' as metric, round(avg((p - y) ** 2), 6) as value, count(*) as n from pred""")
def _(t):
    return rounded(M.brier(predictions(t.lineitem), "y", "p"), "value")


@query("mx10_ks_gini", GLOBAL_CURVE + """
, z as (select *, sum(pos) over () as p_all, sum(neg) over () as n_all, sum(pos) over (order by score) as pu from r)
select round(max(abs(pu / p_all::double - (nb + neg) / n_all::double)), 6) as ks,
       round(2 * sum(pos::double * (nb + neg / 2.0)) / (max(p_all)::double * max(n_all)) - 1, 6) as gini from z""")
def _(t):
    return rounded(M.ks_gini(predictions(t.lineitem), "y", "p"), "ks", "gini")


@query("mx11_fold_mean_se", "with " + PRED + """
, f as (select channel, l_linenumber as fold, -avg(abs(y - p)) as s from pred group by all)
select channel, count(s) as folds, round(avg(s), 6) as mean, round(stddev_samp(s) / sqrt(count(s)), 6) as se
from f group by channel""")
def _(t):
    folds = M.neg_mae(predictions(t.lineitem).withColumn("fold", F.col("l_linenumber")), "y", "p", ["channel", "fold"])
    return rounded(M.fold_stats(folds, "value", ["channel"]), "mean", "se")


SEG = ("with " + PRED.replace("l_returnflag as segment", "l_linestatus || l_linenumber as segment")
       + AUC.format(g="segment,", part="partition by segment"))


@query("mx12_metric_by_segment", SEG + """
, m as (select segment, sum(pos + neg)::bigint as n, sum(pos)::bigint as pos,
          sum(pos::double * (nb + neg / 2.0)) / (sum(pos)::double * sum(neg)) as auc,
          sum(pos * tp / (tp + fp)::double) / sum(pos) as ap from r group by segment),
e as (select segment, avg(case when y <> round_even(p, 0) then 1 else 0 end) as error_rate from pred group by segment),
gc as (select p as score, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from pred group by all),
g as (select sum(pos::double * (nb + neg / 2.0)) / (sum(pos)::double * sum(neg)) as oa from
        (select *, sum(neg) over (order by score) - neg as nb from gc))
select segment, n, pos, round(auc, 6) as auc, round(ap, 6) as ap, round(error_rate, 6) as error_rate,
       round(oa, 6) as overall_auc, n >= 30 and auc < oa - 0.05 as collapsed
from m join e using (segment) cross join g""")
def _(t):
    df = predictions(t.lineitem).withColumn("segment", F.concat("channel", "l_linenumber"))
    return rounded(M.by_segment(df, "y", "p", "segment"), "auc", "ap", "error_rate", "overall_auc")
