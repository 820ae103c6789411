"""Explanation, feature-build and scoring queries."""
from pyspark.sql import functions as F

from firmground.operators import calibrate as C, explain as X, features as B, metrics as M
from firmground.plans.registry import query
from firmground.plans.scored import KEY
from firmground.plans.scores import rounded

COEFS = {"l_quantity": 0.02, "l_extendedprice": 0.00001, "l_discount": -3.0, "l_tax": 1.5}
K = ", ".join(KEY)
CONTRIB = f"""m as (select avg(l_quantity) as a, avg(l_extendedprice) as b, avg(l_discount) as c, avg(l_tax) as d from lineitem),
w as (select row_number() over () as rid, {K}, 0.02::double * (l_quantity - a) as l_quantity, 0.00001::double * (l_extendedprice - b) as l_extendedprice,
  -3.0::double * (l_discount - c) as l_discount, 1.5::double * (l_tax - d) as l_tax from lineitem, m),
u as (unpivot w on l_quantity, l_extendedprice, l_discount, l_tax into name feature value contribution)"""
CATALOG = """cat as (select * from (values ('l_quantity', 'aggregation', 'large baskets'), ('l_extendedprice', 'aggregation', 'price level'),
  ('l_discount', 'ratio', 'discount depth')) as t(feature, family, rationale))"""


def catalog(t):
    return t.spark.createDataFrame([("l_quantity", "aggregation", "large baskets"), ("l_extendedprice", "aggregation", "price level"),
                                    ("l_discount", "ratio", "discount depth")], "feature string, family string, rationale string")


@query("xp01_linear_contributions", f"with {CONTRIB} select {K}, feature, round(contribution, 6) + 0.0 as contribution from u")
def _(t):
    return rounded(X.linear_contrib(t.lineitem, KEY, COEFS), "contribution")


@query("xp02_family_attribution", f"""with {CONTRIB}, {CATALOG}, f as (select feature, avg(abs(contribution)) as v from u group by 1)
select coalesce(family, 'uncatalogued') as family, round(sum(v), 6) as total, round(100 * sum(v) / (select sum(v) from f), 4) as pct, count(*) as n_features
from f left join cat using (feature) group by 1""")
def _(t):
    out = X.family_attr(X.linear_contrib(t.lineitem, KEY, COEFS), catalog(t))
    return rounded(rounded(out, "total"), "pct", n=4)


@query("xp03_reason_codes", f"""with {CONTRIB}, {CATALOG}, r as (select *, row_number() over (partition by rid order by abs(contribution) desc, feature)::int as rank from u)
select {K}, rank, feature, coalesce(family, 'uncatalogued') as family, round(contribution, 6) as contribution,
  case when contribution > 0 then 'increases' else 'decreases' end as direction,
  coalesce(rationale, 'feature: ' || feature) || ' (' || coalesce(family, 'uncatalogued') || ' family)' as reason
from r left join cat using (feature) where rank <= 2""")
def _(t):
    return rounded(X.reason_codes(t.lineitem, KEY, COEFS, catalog(t), 2), "contribution")


HASH = "('0x' || substr(md5('7:{f}' || l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_suppkey), 1, 8))::bigint % 2147483647"
REST = "l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
RANK = "row_number() over (order by " + HASH + f", {K}, {REST}) - 1"


@query("xp04_permutation_importance", f"""
with x as (select {K}, (l_returnflag = 'R')::int as y, (l_returnflag = 'R')::int * 0.4::double + l_discount as hint, l_quantity as qty, {REST} from lineitem),
r as (select *, {RANK.format(f='home')} as h, {RANK.format(f='hint')} as a, {RANK.format(f='l_quantity')} as b from x),
s as (select 'base' as f, y, hint, qty from r union all select 'hint', r.y, o.hint, r.qty from r join r o on r.h = o.a
  union all select 'l_quantity', r.y, r.hint, o.qty from r join r o on r.h = o.b),
p as (select f, y, round(1 / (1 + exp(-(-1.0::double + 4.0::double * hint + 0.01::double * qty))), 9) as p from s),
c as (select f, p, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from p group by all),
q as (select *, sum(neg) over (partition by f order by p) - neg as nb from c),
m as (select f, sum(pos::double * (nb + neg / 2.0)) / (sum(pos)::double * sum(neg)) as v from q group by 1)
select m.f as feature, round(b.v, 6) as base, round(m.v, 6) as permuted, round(b.v - m.v, 6) as importance from m, m b where b.f = 'base' and m.f <> 'base'""")
def _(t):
    df = t.lineitem.withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).withColumn(
        "hint", F.col("y") * 0.4 + F.col("l_discount"))
    out = X.permutation_importance(
        df, KEY, ["hint", "l_quantity"], lambda d: d.withColumn("p", F.round(X.linear_score({"hint": 4.0, "l_quantity": 0.01}, -1.0), 9)),
        lambda d: M.auc(d, "y", "p"), inputs=["y", "hint", "l_quantity"])
    return rounded(out, "base", "permuted", "importance")


SPEC = [B.Feature("revenue", "l_extendedprice * (1 - l_discount)", inputs=("l_extendedprice", "l_discount")),
        B.Feature("unit_price", "try_divide(l_extendedprice, l_quantity)", inputs=("l_extendedprice", "l_quantity")),
        B.Feature("is_late", "cast(l_linestatus = 'F' as int)", "int", ("l_linestatus",)),
        B.Feature("loyalty", "c_loyalty_points * 2", inputs=("c_loyalty_points",))]


@query("pb01_feature_build", f"""select {K}, round(l_extendedprice * (1 - l_discount), 8) as revenue, round(l_extendedprice / l_quantity, 8) as unit_price,
  (l_linestatus = 'F')::int as is_late, null::double as loyalty from lineitem""")
def _(t):
    built, _ = B.build(t.lineitem, SPEC, KEY)
    return rounded(built, "revenue", "unit_price", n=8)


@query("pb01_feature_validation", """select unnest(['revenue', 'unit_price', 'is_late', 'loyalty']) as feature, unnest([true, true, true, false]) as present,
  unnest([count(*), count(l_extendedprice / l_quantity), count(*), 0]) as known, unnest([count(*), count(*), count(*), count(*)]) as n_rows,
  unnest(['', '', '', 'missing_input']) as issue from lineitem""")
def _(t):
    built, missing = B.build(t.lineitem, SPEC, KEY)
    return B.validate(built, SPEC, missing)


@query("pb03_batch_score", f"""with s as (select {K}, 1 / (1 + exp(-(-0.5::double + 0.02::double * l_quantity - 3.0::double * l_discount + 1.5::double * l_tax))) as p from lineitem),
c as (select *, 1 / (1 + exp(-(2.0::double * p - 1.0::double))) as p_cal from s)
select {K}, round(p, 6) as p, round(p_cal, 6) as p_cal, (p_cal >= 0.5)::int as decision from c""")
def _(t):
    model = X.linear_score({"l_quantity": 0.02, "l_discount": -3.0, "l_tax": 1.5}, -0.5)
    done = B.score(t.lineitem.select(*KEY, "l_quantity", "l_discount", "l_tax"), model, 0.5, C.Platt(2.0, -1.0).apply)
    return rounded(done.select(*KEY, "p", "p_cal", "decision"), "p", "p_cal")
