"""Monitoring, contract and rollout queries."""
from pyspark.sql import functions as F

from firmground.operators import metrics as M, monitor as W
from firmground.operators.decide import band_of
from firmground.plans.registry import query
from firmground.plans.scored import KEY, PRED, predictions
from firmground.plans.scores import rounded

CUT = "timestamp '1998-01-01'"
SIDES = f"""a as (select o_totalprice, o_orderstatus, o_orderpriority from orders where o_orderdate < {CUT}),
b as (select o_totalprice * 1.15 + 20000 as o_totalprice, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end as o_orderstatus,
  o_orderpriority, o_orderdate from orders where o_orderdate >= {CUT})"""


def sides(t):
    cut = F.to_timestamp(F.lit("1998-01-01"))
    cols = ["o_totalprice", "o_orderstatus", "o_orderpriority"]
    new = t.orders.where(F.col("o_orderdate") >= cut).select(
        (F.col("o_totalprice") * 1.15 + 20000).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_orderpriority", "o_orderdate")
    return t.orders.where(F.col("o_orderdate") < cut).select(*cols), new


EDGES = """q as (select quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from a)"""
NUM = "(" + " + ".join(f"(e[{i}] < o_totalprice)::int" for i in range(1, 10)) + ")::varchar"
PSI = f"""with {SIDES}, {EDGES},
ra as (select 'o_totalprice' as c, {NUM} as k from a, q union all select 'o_orderstatus', o_orderstatus from a union all select 'o_orderpriority', o_orderpriority from a),
rb as (select 'o_totalprice' as c, {NUM} as k from b, q union all select 'o_orderstatus', o_orderstatus from b union all select 'o_orderpriority', o_orderpriority from b),
na as (select c, k, count(*) as r from ra group by all), nb as (select c, k, count(*) as n from rb group by all),
j as (select c, k, greatest(coalesce(r, 0) / (select count(*) from a)::double, 1e-4) as rp, greatest(coalesce(n, 0) / (select count(*) from b)::double, 1e-4) as cp
  from na full join nb using (c, k)),
p as (select c, sum((cp - rp) * ln(cp / rp)) as psi from j group by c)
select c as "column", case when c = 'o_totalprice' then 'numeric' else 'categorical' end as kind, round(psi, 6) as psi,
  case when psi < 0.1 then 'negligible' when psi <= 0.25 then 'moderate' else 'significant' end as band, psi > 0.25 as flagged from p"""


@query("mo01_psi_numeric", PSI + " where c = 'o_totalprice'")
def _(t):
    a, b = sides(t)
    return rounded(W.psi(a, b, ["o_totalprice"]), "psi")


@query("mo02_psi_categorical", PSI + " where c = 'o_orderstatus'")
def _(t):
    a, b = sides(t)
    return rounded(W.psi(a, b, ["o_orderstatus"]), "psi")


@query("mo03_drift_report", PSI)
def _(t):
    return rounded(W.psi(*sides(t)), "psi")


@query("mo04_score_ks", f"""
with {PRED}, s as (select p, (ts < {CUT})::int as a, (ts >= {CUT})::int as b from pred),
c as (select p, sum(a) as a, sum(b) as b from s group by p),
u as (select sum(a) over (order by p) as ua, sum(b) over (order by p) as ub, sum(a) over () as na, sum(b) over () as nb from c),
k as (select max(abs(ua / na - ub / nb)) as ks, max(na)::double as na, max(nb)::double as nb from u),
pv as (select ks, sum(case when j % 2 = 1 then 2.0::double else -2.0::double end * exp(-2.0::double * j * j * ks * ks * na * nb / (na + nb))) as pv
  from k, (select unnest(range(1, 101)) as j) group by ks)
select round(ks, 6) as ks, round(least(greatest(pv, 0), 1), 6) as p_value, pv < 0.05 as alert from pv""")
def _(t):
    cut = F.to_timestamp(F.lit("1998-01-01"))
    p = predictions(t.lineitem)
    return rounded(W.score_ks(p.where(F.col("ts") < cut), p.where(F.col("ts") >= cut), "p"), "ks", "p_value")


WEEKLY = f"""with {PRED}, w as (select date_trunc('week', ts)::date as period, -avg(abs(y - p)) as value from pred group by 1),
d as (select *, value < -0.4 - 2 * 0.005::double as below from w),
dt as (select period, value, below, below and coalesce(lag(below) over (order by period) and period - lag(period) over (order by period) = 7, false) as trigger from d)"""


def weekly(t):
    p = predictions(t.lineitem).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return W.decay(M.neg_mae(p, "y", "p", ["week"]), "week", "value", -0.4, 0.005)


@query("mo05_decay", WEEKLY + "select period, round(value, 6) as value, below, trigger from dt")
def _(t):
    return rounded(weekly(t), "value")


@query("mo06_queue_size", """
select ts::date as day, count(*) filter (value > 80) as queue, count(*) filter (value > 80) > 70 as over_capacity,
  round(count(*) filter (value > 80) / 64.0::double - 1, 6) as drift from events group by 1""")
def _(t):
    return rounded(W.queue_size(t.events, "ts", F.col("value") > 80, 70, 64.0), "drift")


@query("mo07_action_rate", """
select date_trunc('week', ts)::date as week, count(*) as flagged, round(avg((event_type in ('purchase', 'click', 'error'))::int), 6) as rate,
  avg((event_type in ('purchase', 'click', 'error'))::int) < 0.6 as trigger from events where value > 80 group by 1""")
def _(t):
    acted = F.col("event_type").isin("purchase", "click", "error")
    return rounded(W.action_rate(t.events, "ts", F.col("value") > 80, acted, 0.6), "rate")


@query("mo08_retrain_triggers", WEEKLY.replace("with ", PSI.replace(')\nselect c as "column"', '),\nfin as (select c as "column"') + "), ", 1) + """
, ar as (select avg((event_type in ('purchase', 'click'))::int) < 0.5 as tr from events where value > 80 group by date_trunc('week', ts)),
h as (select 'input_drift' as "check", count(*) as hits from fin where "column" in ('o_totalprice', 'o_orderstatus') and psi > 0.2
 union all select 'performance_decay', count(*) from dt where trigger union all select 'action_rate', count(*) from ar where tr)
select "check", hits > 0 as fired, hits from h""")
def _(t):
    drift = rounded(W.psi(*sides(t)), "psi")
    acts = W.action_rate(t.events, "ts", F.col("value") > 80, F.col("event_type").isin("purchase", "click"), 0.5)
    return W.triggers(drift, weekly(t), acts, ["o_totalprice", "o_orderstatus"])


@query("mo09_skew_over_time", f"""with {SIDES}, {EDGES},
ra as (select 'o_totalprice' as c, {NUM} as k from a, q union all select 'o_orderstatus', o_orderstatus from a),
rb as (select date_trunc('month', o_orderdate)::date as period, 'o_totalprice' as c, {NUM} as k from b, q
  union all select date_trunc('month', o_orderdate)::date, 'o_orderstatus', o_orderstatus from b),
na as (select c, k, count(*) as r from ra group by all), nb as (select period, c, k, count(*) as n from rb group by all),
nt as (select period, c, sum(n) as t from nb group by all),
ks as (select distinct c, k from (select c, k from na union all select c, k from nb)),
g as (select period, nt.c, ks.k, t from nt join ks on nt.c = ks.c),
j as (select g.period, g.c, greatest(coalesce(n, 0) / t::double, 1e-4) as cp, greatest(coalesce(r, 0) / (select count(*) from a)::double, 1e-4) as rp
  from g left join nb on g.period = nb.period and g.c = nb.c and g.k = nb.k left join na on na.c = g.c and na.k = g.k),
p as (select period, c, sum((cp - rp) * ln(cp / rp)) as psi from j group by all)
select period, c as "column", case when c = 'o_totalprice' then 'numeric' else 'categorical' end as kind, round(psi, 6) as psi,
  case when psi < 0.1 then 'negligible' when psi <= 0.25 then 'moderate' else 'significant' end as band, psi > 0.25 as flagged from p""")
def _(t):
    a, b = sides(t)
    return rounded(W.skew_over_time(a, b, "o_orderdate", "M", ["o_totalprice", "o_orderstatus"]), "psi")


@query("mo10_parity_diff", """
with a as (select event_id, value as v, event_type as k from events where event_id % 41 <> 0),
b as (select event_id, case when event_id % 13 = 0 then value + 0.5 when event_id % 29 = 0 then null else value end as v,
  case when event_id % 31 = 0 then upper(event_type) else event_type end as k from events where event_id % 37 <> 0),
j as (select a.event_id as ai, b.event_id as bi, a.v as av, b.v as bv, a.k as ak, b.k as bk from a full join b on a.event_id = b.event_id)
select 'v' as feature, count(*) filter (ai is not null and bi is not null) as n_rows,
  count(*) filter (ai is not null and bi is not null and (bv is null or abs(av - bv) > 1e-9)) as mismatches,
  round(count(*) filter (ai is not null and bi is not null and (bv is null or abs(av - bv) > 1e-9)) / count(*) filter (ai is not null and bi is not null)::double, 6) as rate,
  round(max(abs(av - bv)), 6) as max_diff, count(*) filter (bi is null) as only_a, count(*) filter (ai is null) as only_b from j
union all select 'k', count(*) filter (ai is not null and bi is not null), count(*) filter (ai is not null and bi is not null and ak <> bk),
  round(count(*) filter (ai is not null and bi is not null and ak <> bk) / count(*) filter (ai is not null and bi is not null)::double, 6),
  null, count(*) filter (bi is null), count(*) filter (ai is null) from j""")
def _(t):
    i = F.col("event_id")
    a = t.events.where(i % 41 != 0).select("event_id", F.col("value").alias("v"), F.col("event_type").alias("k"))
    b = t.events.where(i % 37 != 0).select(
        "event_id", F.when(i % 13 == 0, F.col("value") + 0.5).when(i % 29 == 0, None).otherwise(F.col("value")).alias("v"),
        F.when(i % 31 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("k"))
    return rounded(W.parity_diff(a, b, ["event_id"], ["v", "k"]), "rate", "max_diff")


@query("mo11_feature_freshness", """
with l as (select user_id, max(case when event_type = 'purchase' then ts end) as a, max(case when event_type = 'error' then ts end) as b from events group by 1),
g as (select (epoch_us(timestamp '2024-01-31') - epoch_us(a)) / 3.6e9 as a, (epoch_us(timestamp '2024-01-31') - epoch_us(b)) / 3.6e9 as b from l)
select 'last_purchase' as feature, count(*) as entities, count(*) filter (coalesce(a > 48, true)) as stale,
  round(count(*) filter (coalesce(a > 48, true)) / count(*)::double, 6) as stale_rate, round(max(a), 6) as max_age_hours from g
union all select 'last_error', count(*), count(*) filter (coalesce(b > 48, true)), round(count(*) filter (coalesce(b > 48, true)) / count(*)::double, 6), round(max(b), 6) from g""")
def _(t):
    x = t.events.select("user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"),
                        F.when(F.col("event_type") == "error", F.col("value")).alias("last_error"))
    return rounded(W.freshness(x, "user_id", "ts", ["last_purchase", "last_error"], "2024-01-31", 48), "stale_rate", "max_age_hours")


@query("mo12_contract_test", """
select 'missing_column' as "check", 'o_clerk' as "column", 'string' as expected, 'absent' as actual
union all select 'type', 'o_custkey', 'int', 'bigint' union all select 'extra_column', 'o_totalprice', 'absent', 'double'
union all select 'extra_column', 'o_orderdate', 'absent', 'timestamp_ntz'
union all select 'grain', 'o_custkey', '0', (count(*) - count(distinct o_custkey))::varchar from orders
union all select 'null_rate', 'o_orderpriority', '0.05', printf('%.4f', avg((o_orderpriority = '5-LOW')::int)) from orders""")
def _(t):
    df = t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return W.contract_test(df, {"o_orderkey": "bigint", "o_custkey": "int", "o_orderstatus": "string", "o_clerk": "string",
                                "o_orderpriority": "string"}, ["o_custkey"], {"o_orderpriority": 0.05, "o_orderstatus": 0.05})


@query("mo13_source_freshness", """
select count(*) filter (ts > timestamp '2024-01-31' - interval 24 hour) as recent_rows,
  round((epoch_us(timestamp '2024-01-31') - epoch_us(max(ts))) / 3.6e9, 6) as lag_hours,
  count(*) filter (ts > timestamp '2024-01-31' - interval 24 hour) > 0 and (epoch_us(timestamp '2024-01-31') - epoch_us(max(ts))) / 3.6e9 <= 2 as passed from events""")
def _(t):
    return rounded(W.source_freshness(t.events, "ts", "2024-01-31", 24, 2.0), "lag_hours")


@query("mo14_shadow", f"""with {PRED}, d as (select case when p >= 0.7 then 'block' when p >= 0.4 then 'review' else 'pass' end as a,
  case when p_base >= 0.7 then 'block' when p_base >= 0.4 then 'review' else 'pass' end as b, {', '.join(KEY)} from pred),
da as (select *, row_number() over (partition by {', '.join(KEY)} order by a) as copy from d),
db as (select *, row_number() over (partition by {', '.join(KEY)} order by b) as copy from d),
e as (select da.a, db.b from da join db using ({', '.join(KEY)}, copy))
select a as champion, b as challenger, count(*) as n, round(count(*) / (select count(*) from e)::double, 6) as share,
  round((select avg((a <> b)::int) from e), 6) as disagreement from e group by all""")
def _(t):
    bands = [(0.0, "pass"), (0.4, "review"), (0.7, "block")]
    p = predictions(t.lineitem)
    a, b = p.select(*KEY, band_of("p", bands).alias("decision")), p.select(*KEY, band_of("p_base", bands).alias("decision"))
    return rounded(W.shadow(a, b, KEY, "decision"), "share", "disagreement")


ROUTE = "case when ('0x' || substr(md5('route:' || {k}::varchar), 1, 8))::bigint % 10000 < 1000 then 'challenger' else 'champion' end"


@query("mo15_route", f"select c_custkey, {ROUTE.format(k='c_custkey')} as arm from customer")
def _(t):
    return W.route(t.customer, "c_custkey", 0.1).select("c_custkey", "arm")


@query("mo16_canary", f"""
with x as (select {ROUTE.format(k='user_id')} as arm, case when event_type = 'error' then 1 else 0 end as bad from events),
g as (select count(*) filter (arm = 'champion') as n_champion, count(*) filter (arm = 'challenger') as n_challenger,
  avg(bad) filter (arm = 'champion') as ra, avg(bad) filter (arm = 'challenger') as rb, avg(bad) as pp from x),
z as (select *, (rb - ra) / sqrt(pp * (1 - pp) * (1.0::double / n_challenger + 1.0::double / n_champion)) as z from g)
select n_champion, n_challenger, round(ra, 6) as rate_champion, round(rb, 6) as rate_challenger, round(z, 4) as stat,
  n_challenger >= 500 as ready, n_challenger >= 500 and z > 1.9599639845400545 as rollback from z""")
def _(t):
    x = W.route(t.events, "user_id", 0.1).withColumn("bad", (F.col("event_type") == "error").cast("int"))
    return rounded(rounded(W.canary(x, "arm", "bad", 500), "rate_champion", "rate_challenger"), "stat", n=4).drop("p")


@query("mo17_label_coverage", """
with s as (select l_orderkey, min(l_shipdate) as known from lineitem where l_partkey % 3 = 0 group by 1),
j as (select floor((epoch_us(known) - epoch_us(o_orderdate)) / 86400000000.0) as lag, known from orders left join s on o_orderkey = l_orderkey)
select count(*) as scored, count(known) as labelled, round(count(known) / count(*)::double, 6) as share,
  quantile_cont(lag, 0.5) as lag_p50, quantile_cont(lag, 0.9) as lag_p90 from j""")
def _(t):
    labels = t.lineitem.where("l_partkey % 3 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("known"))
    return rounded(W.label_coverage(t.orders, labels, ["o_orderkey"], "o_orderdate", "known"), "share")


@query("mo18_realised_value", """
with v as (select l_orderkey, sum(l_extendedprice * l_discount) as gain from lineitem group by 1)
select date_trunc('month', o_orderdate)::date as period, count(*) as cases, round(coalesce(sum(gain), 0), 2) as value
from orders left join v on o_orderkey = l_orderkey where o_orderpriority = '1-URGENT' group by 1""")
def _(t):
    gains = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("gain"))
    acted = t.orders.where("o_orderpriority = '1-URGENT'")
    return rounded(W.realised_value(acted, gains, "o_orderkey", "o_orderdate", "gain"), "value", n=2)
