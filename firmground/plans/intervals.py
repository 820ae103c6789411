"""Bootstrap, comparison and multiple-testing queries."""
from pyspark.sql import functions as F

from firmground.operators import bootstrap as B
from firmground.plans.registry import query
from firmground.plans.scored import PRED, predictions
from firmground.plans.scores import rounded


@query("uc01_bootstrap_ci")
def _(t):
    return B.bootstrap_ci(predictions(t.lineitem), "y", "p", "average_precision", 2000, 0.9)


@query("uc01_bootstrap_ci_auc")
def _(t):
    return B.bootstrap_ci(predictions(t.lineitem), "y", "p", "roc_auc", 2000, 0.9)


@query("uc02_paired_bootstrap")
def _(t):
    return B.paired_bootstrap(predictions(t.lineitem), "y", "p", "p_base", "average_precision", 2000, 0.9)


@query("uc03_baseline_compare")
def _(t):
    return B.paired_bootstrap(predictions(t.lineitem), "y", "p", "p_base", "rmse", 2000, 0.95, 0)


@query("uc03_baseline_compare_auc")
def _(t):
    return B.paired_bootstrap(predictions(t.lineitem), "y", "p", "p_base", "roc_auc", 2000, 0.95, 0)


@query("uc04_row_comparison", "with " + PRED + """
select count(*) as n, round(avg(abs(y - p_base) - abs(y - p)), 6) as delta, count(*) filter (abs(y - p) < abs(y - p_base)) as wins,
  count(*) filter (abs(y - p) > abs(y - p_base)) as losses, count(*) filter (abs(y - p) = abs(y - p_base)) as ties from pred""")
def _(t):
    return rounded(B.compare_rows(predictions(t.lineitem), "y", "p", "p_base"), "delta")


PV = """v as (select p_partkey, power((((p_partkey * 7919) % 1009) + 1) / 1010.0::double, 3) as pv from part)"""


def pvalues(t):
    return t.part.select("p_partkey", F.pow((((F.col("p_partkey") * 7919) % 1009) + 1) / 1010.0, 3).alias("pv"))


@query("uc05_bonferroni", f"""with {PV}
select p_partkey, round(pv, 9) as pv, round(least(pv * (select count(*) from v), 1), 9) as adjusted, pv * (select count(*) from v) <= 0.05 as reject from v""")
def _(t):
    return rounded(B.adjust_pvalues(pvalues(t), "pv", "bonferroni"), "pv", "adjusted", n=9)


@query("uc05_benjamini_hochberg", f"""with {PV}, r as (select *, rank() over (order by pv) - 1 + count(*) over (partition by pv) as k, count(*) over () as n from v),
a as (select p_partkey, pv, least(min(pv * n / k) over (order by pv desc), 1) as adj from r)
select p_partkey, round(pv, 9) as pv, round(adj, 9) as adjusted, adj <= 0.05 as reject from a""")
def _(t):
    return rounded(B.adjust_pvalues(pvalues(t), "pv", "bh"), "pv", "adjusted", n=9)
