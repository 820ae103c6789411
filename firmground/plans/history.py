"""Point-in-time feature queries: every user at three decision times over the event log."""
from pyspark.sql import functions as F

from firmground.operators import pit as P
from firmground.plans.registry import query
from firmground.plans.scores import rounded

DAYS = ["2024-01-10", "2024-01-18", "2024-01-29"]
SPINE = """spine as (select distinct user_id, d from events, (select unnest([timestamp '2024-01-10', timestamp '2024-01-18',
  timestamp '2024-01-29']) as d))"""
JOIN = "from spine s left join events e on e.user_id = s.user_id and e.ts < s.d"
ARGS = ("user_id", "d", "ts")


def spine(t):
    days = F.array(*[F.to_timestamp(F.lit(d)).cast("timestamp_ntz") for d in DAYS])
    return t.events.select("user_id").distinct().select("user_id", F.explode(days).alias("d"))


def out(df, *cols, n=6):
    return rounded(df.withColumn("d", F.to_date("d")), *cols, n=n)


@query("ff00_asof_lookup", f"""
with {SPINE}, r as (select s.user_id, s.d, e.ts, e.event_type, e.value,
  row_number() over (partition by s.user_id, s.d order by e.ts desc, e.event_id desc) as k {JOIN})
select user_id, d::date as d, ts as ts_asof, event_type, value from r where k = 1""")
def _(t):
    return out(P.asof(spine(t), t.events, *ARGS, "event_id", ["event_type", "value"]))


@query("ff01_aggregation", f"""
with {SPINE} select s.user_id, s.d::date as d,
  case when count(value) >= 2 then round(avg(value), 8) end as value_mean,
  case when count(value) >= 2 then round(sum(value), 8) end as value_sum,
  case when count(value) >= 2 then max(value) end as value_max,
  case when count(value) >= 2 then round(stddev_samp(value), 8) end as value_std
{JOIN} and e.ts >= s.d - interval 7 day group by all""")
def _(t):
    return out(P.aggregation(spine(t), t.events, *ARGS, 7, "value"), "value_mean", "value_sum", "value_std", n=8)


@query("ff02_behavioral", f"""
with {SPINE} select s.user_id, s.d::date as d, count(*) filter (event_type = 'purchase') as n_purchase,
  count(*) filter (event_type = 'purchase') > 0 as any_purchase
{JOIN} and e.ts >= s.d - interval 3 day group by all""")
def _(t):
    return out(P.behavioral(spine(t), t.events, *ARGS, 3, "event_type", "purchase"))


@query("ff03_frequency", f"""
with {SPINE}, f as (select user_id, min(ts) as f from events group by 1),
c as (select s.user_id, s.d, count(e.ts) as n {JOIN} and e.ts >= s.d - interval 14 day group by all),
x as (select c.*, (epoch_us(d) - epoch_us(f)) / 86400000000.0::double as ten from c join f using (user_id))
select user_id, d::date as d, n, round(case when ten > 0 then least(ten, 14.0) end, 6) as exposure_days,
  round(n / case when ten > 0 then least(ten, 14.0::double) end, 6) as rate from x""")
def _(t):
    return out(P.frequency(spine(t), t.events, *ARGS, 14), "exposure_days", "rate")


@query("ff04_velocity", f"""
with {SPINE} select s.user_id, s.d::date as d,
  round((avg(value) filter (ts >= s.d - interval 4 day) - avg(value) filter (ts < s.d - interval 4 day)) / 4.0::double, 9) as velocity
{JOIN} and e.ts >= s.d - interval 8 day group by all""")
def _(t):
    return out(P.velocity(spine(t), t.events, *ARGS, 4, "value"), "velocity", n=9)


@query("ff05_trend", f"""
with {SPINE}, y as (select user_id, ts::date as day, avg(value) as y from events group by all),
j as (select s.user_id, s.d, datediff('day', date '2024-01-01', y.day) as x, y.y from spine s left join y
  on y.user_id = s.user_id and y.day < s.d and y.day >= s.d - interval 8 day)
select user_id, d::date as d, case when count(y) >= 5 then round(regr_slope(y, x), 8) end as trend from j group by all""")
def _(t):
    return out(P.trend(spine(t), t.events, *ARGS, 8, "value"), "trend", n=8)


@query("ff06_ratio", f"""
with {SPINE}, c as (select s.user_id, s.d, count(*) filter (event_type = 'purchase') as n_buy,
  count(*) filter (event_type = 'click') as n_click {JOIN} and e.ts >= s.d - interval 5 day group by all)
select user_id, d::date as d, n_buy, n_click, round(case when n_click = 0 then 0.0 else n_buy / n_click::double end, 6) as buy_per_click from c""")
def _(t):
    counts = P.window_features(spine(t), t.events, *ARGS, 5, {
        "n_buy": ("count", F.col("event_type") == "purchase"), "n_click": ("count", F.col("event_type") == "click")})
    return out(P.ratio(counts, "n_buy", "n_click", "buy_per_click", 0.0), "buy_per_click")


@query("ff07_temporal", """
with a as (select user_id, min(ts) as first_ts from events group by 1)
select event_id, hour(ts)::int as hour, (dayofweek(ts) + 1)::int as weekday,
  datediff('day', first_ts::date, ts::date)::int as days_since from events join a using (user_id)""")
def _(t):
    anchored = t.events.join(P.first_seen(t.events, "user_id", "ts"), "user_id")
    return P.temporal(anchored, "ts", "_first").select("event_id", "hour", "weekday", "days_since")


@query("ff08_seasonality", """
select o_orderkey, round(sin(2 * pi() / 365.25 * dayofyear(o_orderdate)), 6) + 0.0 as year_sin,
  round(cos(2 * pi() / 365.25 * dayofyear(o_orderdate)), 6) + 0.0 as year_cos from orders""")
def _(t):
    s = P.seasonality(t.orders, F.dayofyear("o_orderdate").cast("double"), 365.25, "year")
    return rounded(s.select("o_orderkey", "year_sin", "year_cos"), "year_sin", "year_cos")


@query("ff09_lifetime", f"""
with {SPINE}, c as (select s.user_id, s.d, min(e.ts) as f, max(e.ts) as l {JOIN} group by all),
x as (select *, floor((epoch_us(d) - epoch_us(f)) / 86400000000.0)::int as age, (epoch_us(d) - epoch_us(l)) / 86400000000.0 as idle from c)
select user_id, d::date as d, age as tenure_days,
  case when f is null then null when age < 12 then 'new' when idle >= 1 then 'dormant' else 'established' end as stage from x""")
def _(t):
    return out(P.lifetime(spine(t), t.events, *ARGS, 12, 1))


@query("ff10_anomaly", """
with w as (select event_id, value, count(value) over w as n, avg(value) over w as m, stddev_samp(value) over w as s from events
  window w as (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding))
select event_id, case when n >= 5 and s > 0 then round((value - m) / s, 4) end as anomaly from w""")
def _(t):
    a = P.anomaly(t.events, "user_id", "ts", "event_id", "value")
    return rounded(a.select("event_id", "anomaly"), "anomaly", n=4)


@query("ff11_peer_comparison", f"""
with {SPINE}, v as (select s.user_id, s.user_id % 5 as cohort, s.d, count(e.ts) as n {JOIN} and e.ts >= s.d - interval 7 day group by all)
select user_id, cohort, d::date as d, n, case when count(*) over g >= 20 then round(percent_rank() over (g order by n), 6) end as peer_rank,
  case when count(*) over g >= 20 then round((n - avg(n) over g) / stddev_samp(n) over g, 6) end as peer_z from v window g as (partition by cohort, d)""")
def _(t):
    v = P.window_features(spine(t), t.events, *ARGS, 7, {"n": ("count", F.col("ts"))}).withColumn(
        "cohort", F.col("user_id") % 5)
    return out(P.peers(v, ["cohort", "d"], "n"), "peer_rank", "peer_z")


@query("ff12_sequence", f"""
with {SPINE}, g as (select user_id, ts, lag(event_type) over w || '>' || event_type as gram from events
  window w as (partition by user_id order by ts, event_id)),
j as (select s.user_id, s.d, g.gram from spine s left join g on g.user_id = s.user_id and g.ts < s.d)
select user_id, d::date as d, count(*) filter (gram = 'view>click') as seq_view_click,
  count(*) filter (gram = 'click>purchase') as seq_click_purchase, count(*) filter (gram = 'error>error') as seq_error_error
from j group by all""")
def _(t):
    return out(P.sequence(spine(t), t.events, *ARGS, "event_id", "event_type",
                          ["view>click", "click>purchase", "error>error"]))


@query("ff12_sequence_support", """
with g as (select lag(event_type, 2) over w || '>' || lag(event_type) over w || '>' || event_type as gram, user_id from events
  window w as (partition by user_id order by ts, event_id))
select gram, count(*) as n, count(distinct user_id) as entities from g where gram is not null group by 1""")
def _(t):
    return P.transitions(t.events, "user_id", "ts", "event_id", "event_type", 3).groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("entities"))


@query("ff13_graph_sharing", f"""
with {SPINE}, e as (select event_id, user_id, ts, (event_id * 7919) % 60 as device,
  case when event_type = 'error' and value > 100 then 1 else 0 end as bad from events),
h as (select s.user_id, s.d, max_by(e.device, (e.ts, e.event_id)) as device from spine s left join e on e.user_id = s.user_id and e.ts < s.d group by all),
n as (select h.user_id, h.d, count(distinct e.user_id) filter (e.user_id <> h.user_id) as shared_with,
  count(distinct e.user_id) filter (e.user_id <> h.user_id and e.bad = 1) as nb
  from h left join e on e.device = h.device and e.ts < h.d group by all)
select user_id, d::date as d, shared_with, case when shared_with > 0 then round(nb / shared_with::double, 6) end as neighbour_rate from n""")
def _(t):
    edges = t.events.select("event_id", "user_id", "ts", ((F.col("event_id") * 7919) % 60).alias("device"),
                            F.when((F.col("event_type") == "error") & (F.col("value") > 100), 1).otherwise(0).alias("bad"))
    return out(P.sharing(spine(t), edges, *ARGS, "event_id", "device", "bad"), "neighbour_rate")


@query("ff13_graph_union", f"""
with {SPINE}, e as (select user_id, ts, (event_id * 7919) % 997 as device, (event_id * 104729) % 1499 as address,
  (event_type = 'error' and value > 100)::int as bad from events),
u as (select 'device' as a, device as v, user_id, min(ts) as t from e group by all union all select 'address', address, user_id, min(ts) from e group by all),
asked as (select s.user_id, s.d, u.a, u.v from spine s join u on u.user_id = s.user_id and u.t < s.d),
met as (select k.user_id, k.d, k.a, k.v, o.user_id as other, count(*) over (partition by k.user_id, k.d, k.a, k.v) as users
  from asked k join u o on o.a = k.a and o.v = k.v and o.t < k.d),
near as (select distinct user_id, d, other from met where users <= 8 and other <> user_id),
b as (select user_id, min(ts) as t from e where bad = 1 group by 1),
n as (select near.user_id, near.d, count(*) as n, count(*) filter (b.t < near.d) as nb from near left join b on b.user_id = near.other group by all)
select user_id, d::date as d, coalesce(n, 0) as shared_with, case when n > 0 then round(nb / n::double, 6) end as neighbour_rate from spine left join n using (user_id, d)""")
def _(t):
    edges = t.events.select("user_id", "ts", ((F.col("event_id") * 7919) % 997).alias("device"), ((F.col("event_id") * 104729) % 1499).alias("address"),
                            F.when((F.col("event_type") == "error") & (F.col("value") > 100), 1).otherwise(0).alias("bad"))
    return out(P.sharing_union(spine(t), edges, *ARGS, ["device", "address"], 8, "bad"), "neighbour_rate")


@query("ff14_interaction", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * l_discount, 6) as qty_x_discount from lineitem""")
def _(t):
    x = P.interaction(t.lineitem, "l_quantity", "l_discount", "qty_x_discount")
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty_x_discount"), "qty_x_discount")


@query("ff15_business_rule", f"""
with {SPINE} select s.user_id, s.d::date as d, count(*) filter (event_type = 'error') as error_burst_n,
  count(*) filter (event_type = 'error') >= 3 as error_burst {JOIN} and e.ts >= s.d - interval 7 day group by all""")
def _(t):
    return out(P.business_rule(spine(t), t.events, *ARGS, "error_burst", F.col("event_type") == "error", 7, 3))
