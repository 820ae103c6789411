"""Experiment and effect queries: users of the event log split by a hash, regions as arms."""
from statistics import NormalDist

from pyspark.sql import functions as F

from firmground.functions.columns import md5_bucket
from firmground.operators import experiments as X
from firmground.plans.registry import query
from firmground.plans.scores import rounded

ZZ = repr((NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)) ** 2)
ARM = "case when ('0x' || substr(md5('exp:' || user_id::varchar), 1, 8))::bigint % 2 = 0 then 'a' else 'b' end"


def armed(df, key="user_id"):
    return df.withColumn("arm", F.when(md5_bucket(key, 2, "exp:") == 0, "a").otherwise("b"))


@query("ex01_sample_size_rate", f"""
with x as (select l_linestatus, (l_returnflag = 'R')::int as y from lineitem),
g as (select l_linestatus, avg(y) as b, stddev_samp(y) as s, avg(y) * 0.05 as m from x group by 1)
select l_linestatus, round(b, 6) as baseline, round(s, 6) as std, round(m, 6) as mde,
  floor((b * (1 - b) + (b + m) * (1 - b - m)) * {ZZ}::double / (m * m))::bigint + 1 as n_per_arm from g""")
def _(t):
    x = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(X.sample_size(x, "y", "l_linestatus", 0.05, relative=True), "baseline", "std", "mde")


@query("ex02_sample_size_mean", f"""
with g as (select event_type, avg(value) as b, stddev_samp(value) as s from events group by 1)
select event_type, round(b, 6) as baseline, round(s, 6) as std, 2.5::double as mde,
  floor(2 * s * s * {ZZ}::double / 6.25)::bigint + 1 as n_per_arm from g""")
def _(t):
    return rounded(X.sample_size(t.events, "value", "event_type", 2.5, "mean"), "baseline", "std")


@query("ex03_detectable_effect", f"""
with r as (select l_linestatus as seg, count(*) as n, avg((l_returnflag = 'R')::int) as p, stddev_samp((l_returnflag = 'R')::int) as s from lineitem group by 1),
d as (select *, sqrt({ZZ}::double * 2 * p * (1 - p) / n) as f from r),
m as (select event_type as seg, count(*) as n, avg(value) as p, stddev_samp(value) as s from events group by 1)
select seg, n, round(p, 6) as baseline, round(s, 6) as std, round(sqrt({ZZ}::double * (p * (1 - p) + (p + f) * (1 - p - f)) / n), 6) as detectable from d
union all select seg, n, round(p, 6), round(s, 6), round(sqrt(2 * s * s * {ZZ}::double / n), 6) from m""")
def _(t):
    x = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("seg"))
    e = t.events.select(F.col("value").alias("y"), F.col("event_type").alias("seg"))
    both = X.detectable(x, "y", "seg").unionByName(X.detectable(e, "y", "seg", "mean"))
    return rounded(both, "baseline", "std", "detectable")


@query("ex05_unit_check", f"""
with x as (select user_id, case when event_id % 500 = 0 then 'b' else {ARM} end as arm from events),
m as (select user_id, count(distinct arm) as k from x group by 1)
select arm, count(*) as n_rows, count(distinct x.user_id) as n_units, count(distinct x.user_id) filter (k > 1) as mixed_units,
  round(count(*) / count(distinct x.user_id)::double, 6) as rows_per_unit from x join m using (user_id) group by arm""")
def _(t):
    x = armed(t.events).withColumn("arm", F.when(F.col("event_id") % 500 == 0, "b").otherwise(F.col("arm")))
    return rounded(X.unit_check(x, "user_id", "arm"), "rows_per_unit")


UNITS = f"""u as (select user_id, {ARM} as arm, max((event_type = 'purchase' and value > 150)::int) as big, avg(value) as spend,
  count(*) filter (event_type = 'error') as errors from events group by all)"""


@query("ex06_arm_readout", f"""
with {UNITS}, g as (select arm, count(*) as n, avg(big) as r, avg(spend) as m, var_samp(spend) as v, avg(errors) as e, var_samp(errors) as ev from u group by 1),
j as (select a.n as na, b.n as nb, a.r as ra, b.r as rb, a.m as ma, b.m as mb, a.v / a.n as qa, b.v / b.n as qb, a.e as ea, b.e as eb, a.ev / a.n as xa, b.ev / b.n as xb,
  (a.r * a.n + b.r * b.n) / (a.n + b.n) as pp from g a join g b on a.arm = 'a' and b.arm = 'b')
select 'big_buyers' as metric, 'primary' as role, na as n_a, nb as n_b, round(ra, 6) as mean_a, round(rb, 6) as mean_b, round(rb - ra, 6) as diff,
  round((rb - ra) / sqrt(pp * (1 - pp) * (1.0::double / na + 1.0::double / nb)), 4) as stat, null::double as df, 0.02::double as bar,
  rb - ra >= 0.02 and abs((rb - ra) / sqrt(pp * (1 - pp) * (1.0::double / na + 1.0::double / nb))) > 1.9599639845400545 as ok from j
union all select 'spend', 'guardrail', na, nb, round(ma, 6), round(mb, 6), round(mb - ma, 6), round((mb - ma) / sqrt(qa + qb), 4),
  round((qa + qb) ** 2 / (qa * qa / (na - 1) + qb * qb / (nb - 1)), 2), 5.0, mb - ma >= -5 from j
union all select 'errors', 'guardrail', na, nb, round(ea, 6), round(eb, 6), round(eb - ea, 6), round((eb - ea) / sqrt(xa + xb), 4),
  round((xa + xb) ** 2 / (xa * xa / (na - 1) + xb * xb / (nb - 1)), 2), 0.1, eb - ea >= -0.1 from j""")
def _(t):
    u = X.to_units(armed(t.events), "user_id", ["arm"], [
        F.max(((F.col("event_type") == "purchase") & (F.col("value") > 150)).cast("int")).alias("big"),
        F.avg("value").alias("spend"), F.count_if(F.col("event_type") == "error").alias("errors")])
    r = X.arm_readout(u, "arm", "a", "b", {
        "big_buyers": ("big", "rate", "primary", 0.02), "spend": ("spend", "mean", "guardrail", 5.0),
        "errors": ("errors", "mean", "guardrail", 0.1)})
    return rounded(rounded(rounded(r, "mean_a", "mean_b", "diff"), "stat", n=4), "df", n=2).drop("p")


@query("ex07_novelty", f"""
with x as (select *, {ARM} as arm, min(ts) over (partition by user_id) as f from events),
d as (select floor((epoch_us(ts) - epoch_us(f)) / 86400000000.0)::int as day, arm, value from x)
select day, count(*) filter (arm = 'a') as n_a, count(*) filter (arm = 'b') as n_b,
  round(avg(value) filter (arm = 'b') - avg(value) filter (arm = 'a'), 6) as effect from d group by 1""")
def _(t):
    return rounded(X.novelty(armed(t.events), "user_id", "ts", "arm", "a", "b", "value"), "effect")


def cells(treated, post):
    return (f"(avg(y) filter ({treated} and {post}) - avg(y) filter ({treated} and not ({post}))) - "
            f"(avg(y) filter (not ({treated}) and {post}) - avg(y) filter (not ({treated}) and not ({post})))")


DID = """x as (select n_regionkey, n_nationkey, o_orderdate as d, o_orderstatus, o_custkey,
  o_totalprice + case when n_regionkey in (1, 2) and o_orderdate >= timestamp '1999-01-01' then 9000 else 0 end as y
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def did_frame(t):
    hit = F.col("n_regionkey").isin(1, 2)
    post = F.col("o_orderdate") >= F.to_timestamp(F.lit("1999-01-01"))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "y", F.col("o_totalprice") + F.when(hit & post, 9000).otherwise(0)), hit, post


@query("ex08_did", f"""with {DID}
select count(y) as n, round(avg(y) filter (n_regionkey not in (1, 2) and d < timestamp '1999-01-01'), 4) as control_pre,
 round(avg(y) filter (n_regionkey not in (1, 2) and d >= timestamp '1999-01-01'), 4) as control_post,
 round(avg(y) filter (n_regionkey in (1, 2) and d < timestamp '1999-01-01'), 4) as treated_pre,
 round(avg(y) filter (n_regionkey in (1, 2) and d >= timestamp '1999-01-01'), 4) as treated_post,
 round({cells("n_regionkey in (1, 2)", "d >= timestamp '1999-01-01'")}, 4) as effect from x""")
def _(t):
    df, hit, post = did_frame(t)
    return rounded(X.did(df, "y", hit, post), "control_pre", "control_post", "treated_pre", "treated_post", "effect", n=4)


@query("ex09_overlap", """
select p_brand, p_type, count(*) filter (p_size > 25) as n_treated, count(*) filter (p_size <= 25) as n_control,
  count(*) filter (p_size > 25) = 0 or count(*) filter (p_size <= 25) = 0 as one_sided from part group by all""")
def _(t):
    return X.overlap(t.part, F.col("p_size") > 25, ["p_brand", "p_type"])


@query("ex10_balance", """
with g as (select 'l_quantity' as covariate, l_quantity as v, l_returnflag = 'R' as t from lineitem union all
  select 'l_extendedprice', l_extendedprice, l_returnflag = 'R' from lineitem),
s as (select covariate, avg(v) filter (t) as a, avg(v) filter (not t) as b, var_samp(v) filter (t) as va, var_samp(v) filter (not t) as vb from g group by 1)
select covariate, round(a, 6) as mean_treated, round(b, 6) as mean_control, round((a - b) / sqrt((va + vb) / 2), 6) as smd,
  abs((a - b) / sqrt((va + vb) / 2)) > 0.1 as unbalanced from s""")
def _(t):
    b = X.balance(t.lineitem, F.col("l_returnflag") == "R", ["l_quantity", "l_extendedprice"])
    return rounded(b, "mean_treated", "mean_control", "smd")


@query("ex10_stratified_effect", """
with c as (select p_brand, p_type, count(*) as n, avg(p_retailprice) filter (p_size > 25) - avg(p_retailprice) filter (p_size <= 25) as d from part group by all)
select count(*) as strata_used, sum(n)::bigint as rows_used, round(sum(n * d) / sum(n), 6) as effect from c where d is not null""")
def _(t):
    return rounded(X.stratified_effect(t.part, "p_retailprice", F.col("p_size") > 25, ["p_brand", "p_type"]), "effect")


@query("ex11_placebo", f"""with {DID}, pre as (select * from x where d < timestamp '1999-01-01')
select '1999-01-01' as cutoff, true as real, round({cells("n_regionkey in (1, 2)", "d >= timestamp '1999-01-01'")}, 4) as effect from x
union all select '1997-01-01', false, round({cells("n_regionkey in (1, 2)", "d >= timestamp '1997-01-01'")}, 4) from pre
union all select '1998-01-01', false, round({cells("n_regionkey in (1, 2)", "d >= timestamp '1998-01-01'")}, 4) from pre""")
def _(t):
    df, hit, _ = did_frame(t)
    return rounded(X.placebo(df, "y", hit, "o_orderdate", "1999-01-01", ["1997-01-01", "1998-01-01"]), "effect", n=4)


@query("ex12_geo_incrementality", f"""with {DID}, s as (select *, case when n_regionkey in (1, 2) and d >= timestamp '1999-01-01' then 500.0::double else 0.0::double end as spend from x),
g as (select n_nationkey, sum(case when d >= timestamp '1999-01-01' then y else 0 end) - sum(case when d < timestamp '1999-01-01' then y else 0 end) as ch,
  sum(case when d >= timestamp '1999-01-01' then spend else 0 end) as sp, bool_or(n_regionkey in (1, 2)) as hit from s group by 1),
r as (select avg(ch) filter (hit) - avg(ch) filter (not hit) as e, count(*) filter (hit) as k, sum(sp) filter (hit) as sp from g)
select round(e, 2) as effect_per_geo, k as treated_geos, round(e * k, 2) as incremental, sp as spend, round(e * k / sp, 6) as iroas from r""")
def _(t):
    df, hit, post = did_frame(t)
    df = df.withColumn("spend", F.when(hit & post, 500.0).otherwise(0.0))
    g = X.geo_incrementality(df, "n_nationkey", post, hit, "y", "spend")
    return rounded(rounded(g, "iroas"), "effect_per_geo", "incremental", n=2)
