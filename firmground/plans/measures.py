"""Credit and marketing measure queries."""
from pyspark.sql import functions as F

from firmground.operators import measures as D, monitor as W
from firmground.plans.registry import query
from firmground.plans.scored import PRED, predictions
from firmground.plans.scores import rounded

WOE = """x as (select (l_returnflag = 'R')::int as y, l_extendedprice, l_linestatus from lineitem),
q as (select quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from x),
u as (select 'l_extendedprice' as feature, (""" + " + ".join(f"(e[{i}] < l_extendedprice)::int" for i in range(1, 10)) + """)::varchar as bin, y from x, q
 union all select 'l_linestatus', l_linestatus, y from x),
c as (select feature, bin, count(*) as n, sum(y)::bigint as bad from u group by all),
t as (select *, (n - bad) / (sum(n - bad) over (partition by feature))::double as g, bad / (sum(bad) over (partition by feature))::double as b from c)"""


def scorecard(t):
    x = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return D.woe(x, "y", ["l_extendedprice", "l_linestatus"])


@query("dm01_woe", f"with {WOE} select feature, bin, n, bad, round(ln(g / b), 6) as woe, round((g - b) * ln(g / b), 8) as iv_part from t")
def _(t):
    return rounded(rounded(scorecard(t), "woe"), "iv_part", n=8)


@query("dm01_information_value", f"with {WOE} select feature, round(sum((g - b) * ln(g / b)), 8) as iv, count(*) as bins from t group by 1")
def _(t):
    return rounded(D.information_value(scorecard(t)), "iv", n=8)


@query("dm02_vintage", """
with c as (select o_custkey, min(o_orderdate) as s, min(case when o_orderpriority = '1-URGENT' then o_orderdate end) as e from orders group by 1),
r as (select date_trunc('month', s)::date as cohort, (year(e) * 12 + month(e)) - (year(s) * 12 + month(s)) as age from c),
z as (select cohort, count(*) as size from r group by 1), g as (select cohort, size, unnest(range(0, 13)) as age from z),
h as (select cohort, age, count(*) as events from r where age between 0 and 12 group by all),
f as (select g.cohort, g.age::int as age, size, coalesce(events, 0) as events from g left join h on g.cohort = h.cohort and g.age = h.age)
select *, (sum(events) over (partition by cohort order by age))::bigint as cum_events, round(sum(events) over (partition by cohort order by age) / size, 6) as rate from f""")
def _(t):
    c = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.min(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("e"))
    return rounded(D.vintage(c, "s", "e", 12), "rate")


@query("dm03_roll_rates", """
with s as (select o_custkey, year(o_orderdate) as yr, case when count(*) >= 3 then 'high' when count(*) = 2 then 'mid' else 'low' end as st from orders group by all),
m as (select lag(st) over w as a, st as b, yr - lag(yr) over w as g from s window w as (partition by o_custkey order by yr)),
c as (select a as from_state, b as to_state, count(*) as n from m where g = 1 group by all)
select *, round(n / sum(n) over (partition by from_state), 6) as share from c""")
def _(t):
    s = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("c")).withColumn(
        "st", F.when(F.col("c") >= 3, "high").when(F.col("c") == 2, "mid").otherwise("low"))
    return rounded(D.roll_rates(s, "o_custkey", "yr", "st"), "share")


@query("dm04_score_psi", f"with {PRED}" + """,
a as (select p from pred where ts < timestamp '1998-01-01'), b as (select round(p * 0.9, 4) as p from pred where ts >= timestamp '1998-01-01'),
q as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from a),
ca as (select (""" + " + ".join(f"(e[{i}] < p)::int" for i in range(1, 10)) + """) as k, count(*) / (select count(*) from a)::double as r from a, q group by 1),
cb as (select (""" + " + ".join(f"(e[{i}] < p)::int" for i in range(1, 10)) + """) as k, count(*) / (select count(*) from b)::double as c from b, q group by 1),
j as (select greatest(coalesce(r, 0), 1e-4) as r, greatest(coalesce(c, 0), 1e-4) as c from ca full join cb using (k)), s as (select sum((c - r) * ln(c / r)) as psi from j)
select 'p' as "column", 'numeric' as kind, round(psi, 6) as psi, case when psi < 0.1 then 'negligible' when psi <= 0.25 then 'moderate' else 'significant' end as band,
  psi > 0.25 as flagged from s""")
def _(t):
    p = predictions(t.lineitem)
    cut = F.to_timestamp(F.lit("1998-01-01"))
    now = p.where(F.col("ts") >= cut).select(F.round(F.col("p") * 0.9, 4).alias("p"))
    return rounded(W.psi(p.where(F.col("ts") < cut).select("p"), now, ["p"]), "psi")


@query("dm05_expected_loss", f"""with {PRED} select segment, count(*) as n, round(sum(price), 2) as exposure,
  round(sum(p * case channel when 'O' then 0.45 else 0.6 end::double * price), 2) as expected_loss,
  round(sum(p * case channel when 'O' then 0.45 else 0.6 end::double * price) / sum(price), 6) as loss_rate from pred group by 1""")
def _(t):
    lgd = F.when(F.col("channel") == "O", 0.45).otherwise(0.6)
    out = D.expected_loss(predictions(t.lineitem), "segment", F.col("p"), lgd, F.col("price"))
    return rounded(rounded(out, "loss_rate"), "exposure", "expected_loss", n=2)


@query("dm06_attribution", """
with x as (select user_id, ts, event_id, event_type as channel, (event_type = 'purchase')::int as c,
  sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id) - (event_type = 'purchase')::int as path from events),
g as (select user_id, path, max(c) as done, count(*) filter (c = 0) as k, arg_min(channel, (ts, event_id)) filter (c = 0) as f, arg_max(channel, (ts, event_id)) filter (c = 0) as l from x group by all),
d as (select * from g where done = 1 and k > 0),
n as (select channel, sum(1.0::double / k) as linear from x join d using (user_id, path) where c = 0 group by 1)
select n.channel, round(linear, 6) as linear, (select count(*) from d where f = n.channel) as first, (select count(*) from d where l = n.channel) as last from n""")
def _(t):
    return rounded(D.attribution(t.events, "user_id", "ts", "event_id", "event_type", F.col("event_type") == "purchase"), "linear")


@query("dm07_cac_ltv", """
with c as (select c_custkey as k, c_mktsegment as channel, min(o_orderdate) as a from customer join orders on c_custkey = o_custkey group by all),
r as (select * from c where epoch_us(a) + 365 * 86400000000 <= epoch_us(timestamp '2001-08-01')),
v as (select channel, sum(case when o_orderdate >= a and epoch_us(o_orderdate) < epoch_us(a) + 365 * 86400000000 then o_totalprice * 0.05::double else 0 end) as rev
  from r join orders on o_custkey = k group by 1),
h as (select channel, count(*) as customers from r group by 1), s as (select c_mktsegment as channel, sum(abs(c_acctbal)) as cost from customer group by 1)
select channel, customers, round(cost / customers, 4) as cac, round(rev / customers, 4) as ltv, round(rev / cost, 6) as ltv_cac from h join v using (channel) join s using (channel)""")
def _(t):
    orders = t.orders.withColumnRenamed("o_custkey", "k")
    first = orders.groupBy("k").agg(F.min("o_orderdate").alias("a"))
    people = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg")).join(first, "k")
    spend = t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.sum(F.abs("c_acctbal")).alias("cost"))
    revenue = orders.withColumn("amount", F.col("o_totalprice") * 0.05)
    out = D.cac_ltv(people, revenue, spend, "k", "seg", "a", "o_orderdate", "amount", "cost", 365, "2001-08-01")
    return rounded(rounded(out, "ltv_cac"), "cac", "ltv", n=4)


@query("dm08_response_curve", """
with x as (select c_custkey as k, c_acctbal + 1000 as spend, sqrt(c_acctbal + 1000) * 3 + c_custkey % 7 as resp from customer),
b as (select *, ntile(10) over (order by round(spend * 100)::bigint, k)::int as bucket from x),
g as (select bucket, count(*) as n, avg(spend) as s, avg(resp) as r from b group by 1)
select bucket, n, round(s, 4) as spend, round(r, 4) as response, round((r - lag(r) over (order by bucket)) / (s - lag(s) over (order by bucket)), 6) as marginal from g""")
def _(t):
    x = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 1000).alias("spend")).withColumn(
        "resp", F.sqrt("spend") * 3 + F.col("k") % 7)
    return rounded(rounded(D.response_curve(x, "spend", "resp", "k"), "marginal"), "spend", "response", n=4)


@query("dm09_calendar_confound", """
with g as (select o_orderdate::date as day, sum(o_totalprice) as s from orders group by 1),
d as (select day, s * (1 + 0.5::double * (month(day) in (11, 12))::int) as spend from g)
select round(corr(spend, sin(dayofyear(day) * (2 * pi() / 365.25))), 6) as corr_sin, round(corr(spend, cos(dayofyear(day) * (2 * pi() / 365.25))), 6) as corr_cos,
  round(corr(spend, (month(day) in (11, 12))::int), 6) as corr_promo,
  greatest(abs(corr(spend, sin(dayofyear(day) * (2 * pi() / 365.25)))), abs(corr(spend, cos(dayofyear(day) * (2 * pi() / 365.25)))), abs(corr(spend, (month(day) in (11, 12))::int))) > 0.3 as confounded from d""")
def _(t):
    promo = F.month("day").isin(11, 12)
    d = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("s")).withColumn(
        "spend", F.col("s") * (1 + F.when(promo, 0.5).otherwise(0.0)))
    return rounded(D.calendar_confound(d, "day", "spend", promo), "corr_sin", "corr_cos", "corr_promo")
