"""Leakage, label and split queries."""
from pyspark.sql import functions as F

from firmground.functions.columns import micros
from firmground.operators import leakage as L, splits as S
from firmground.operators.audit import periods
from firmground.plans.registry import query
from firmground.plans.scores import rounded

LEAK = """x as (select case when l_returnflag = 'R' then 1 else 0 end as y, l_quantity, l_discount,
  case when l_returnflag = 'R' then 5.0::double else 1.0::double end + l_tax / 100 as final_amount,
  case when l_returnflag = 'R' then l_linestatus end as closed_reason from lineitem)"""


def leak_frame(t):
    yes = F.col("l_returnflag") == "R"
    return t.lineitem.select(
        F.when(yes, 1).otherwise(0).alias("y"), "l_quantity", "l_discount",
        (F.when(yes, 5.0).otherwise(1.0) + F.col("l_tax") / 100).alias("final_amount"),
        F.when(yes, F.col("l_linestatus")).alias("closed_reason"))


@query("lk01_leak_scan", f"""
with {LEAK}
select 'l_quantity' as "column", 'corr' as "check", round(abs(corr(l_quantity, y)), 6) as value, abs(corr(l_quantity, y)) >= 0.98 as flag from x
union all select 'l_discount', 'corr', round(abs(corr(l_discount, y)), 6), abs(corr(l_discount, y)) >= 0.98 from x
union all select 'final_amount', 'corr', round(abs(corr(final_amount, y)), 6), abs(corr(final_amount, y)) >= 0.98 from x
union all select 'closed_reason', 'null_pattern', round(avg(((closed_reason is not null) = (y = 1))::int), 6),
  avg(((closed_reason is not null) = (y = 1))::int) >= 0.99 from x
union all select 'final_amount', 'name', null, true union all select 'closed_reason', 'name', null, true""")
def _(t):
    return rounded(L.leak_scan(leak_frame(t), "y"), "value")


@query("lk03_null_pattern", f"""
with {LEAK} select round(avg(((closed_reason is not null) = (y = 1))::int), 6) as agreement,
  avg(((closed_reason is not null) = (y = 1))::int) >= 0.99 as leak from x""")
def _(t):
    return rounded(L.null_pattern(leak_frame(t), "closed_reason", "y"), "agreement")


OVER = """a as (select case when o_custkey % 3 = 0 then -o_custkey else o_custkey end as k from orders where o_orderdate < timestamp '1999-01-01'),
b as (select case when o_custkey % 5 = 0 then -o_custkey - 1000000000 else o_custkey end as k from orders where o_orderdate >= timestamp '1999-01-01')"""


def sides(t):
    cut = F.to_timestamp(F.lit("1999-01-01"))
    o, key = t.orders, F.col("o_custkey")  # some customers go by another key on one side, so the overlap is partial
    return (o.where(F.col("o_orderdate") < cut).withColumn("o_custkey", F.when(key % 3 == 0, -key).otherwise(key)),
            o.where(F.col("o_orderdate") >= cut).withColumn("o_custkey", F.when(key % 5 == 0, -key - 1000000000).otherwise(key)))


@query("lk04_split_overlap", f"""
with {OVER}, i as (select k from a intersect select k from b)
select (select count(distinct k) from a) as n_a, (select count(distinct k) from b) as n_b, count(*) as n_both,
  round(count(*) / (select count(distinct k) from a)::double, 6) as share_a,
  (select string_agg(k::varchar, ',' order by k) from (select k from i order by k limit 5)) as examples from i""")
def _(t):
    return rounded(L.split_overlap(*sides(t), "o_custkey"), "share_a")


@query("lk05_split_assert", f"""
with {OVER}, i as (select k from a intersect select k from b), d as (select k, count(*) as c from b group by 1)
select 'no_entity_in_both' as "check", count(*) = 0 as passed, count(*) as n_bad from i union all
select 'no_duplicate_in_test', sum(c - 1) = 0, sum(c - 1)::bigint from d""")
def _(t):
    return L.split_assert(*sides(t), "o_custkey")


@query("lk06_feature_parity", """
select unnest(['o_totalprice', 'o_orderpriority', 'extra']) as feature, unnest([true, true, true]) as in_a,
  unnest([true, true, false]) as in_b, unnest([true, false, null]) as same_type,
  unnest([count(*) filter (o_orderkey % 2 = 0), count(*) filter (o_orderkey % 2 = 0), count(*) filter (o_orderkey % 2 = 0)]) as known_a,
  unnest([count(*) filter (o_orderkey % 2 = 1), count(*) filter (o_orderkey % 2 = 1), null]) as known_b from orders""")
def _(t):
    a = t.orders.where("o_orderkey % 2 = 0").withColumn("extra", F.lit(1))
    b = t.orders.where("o_orderkey % 2 = 1").withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int"))
    return L.feature_parity(a, b, ["o_totalprice", "o_orderpriority", "extra"])


@query("lk07_pit_filter", """
with s as (select user_id, ts as d from events where event_type = 'purchase')
select event_id, e.user_id, ts, event_type, value, d as first_decision from events e asof join s on e.user_id = s.user_id and e.ts + interval 6 hour <= s.d""")
def _(t):
    facts = t.events.select("event_id", "user_id", "ts", "event_type", "value",
                            (F.col("ts") + F.expr("interval 6 hours")).alias("available_at"))
    spine = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("decision"))
    return L.pit_filter(spine, facts, "user_id", "decision", "available_at").drop("available_at")


@query("lk08_availability_report", """
with j as (select o_orderdate + interval 30 day as d, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey)
select 'ship_status' as feature, count(l_shipdate) as known_rows, count(*) filter (l_shipdate > d) as late_rows,
  round(count(*) filter (l_shipdate > d) / count(l_shipdate)::double, 6) as late_rate from j
union all select 'order_price', count(o_orderdate), count(*) filter (o_orderdate > d),
  round(count(*) filter (o_orderdate > d) / count(o_orderdate)::double, 6) from j""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_orderdate") + F.expr("interval 30 days")).alias("decision"), "l_shipdate", "o_orderdate")
    out = L.availability_report(j, "decision", {"ship_status": "l_shipdate", "order_price": "o_orderdate"})
    return rounded(out, "late_rate")


@query("lk09_label_maturity", """
with x as (select case when o_orderkey % 100 = 0 then null else o_orderdate end as d from orders)
select count(*) as n_rows, count(*) filter (d is null) as n_bad,
  count(*) filter (floor((epoch_us(timestamp '2001-08-01') - epoch_us(d)) / 86400000000.0) < 90) as censored,
  round(count(*) filter (floor((epoch_us(timestamp '2001-08-01') - epoch_us(d)) / 86400000000.0) < 90) / count(d)::double, 6) as rate
from x""")
def _(t):
    x = t.orders.select(F.when(F.col("o_orderkey") % 100 != 0, F.col("o_orderdate")).alias("d"))
    return rounded(L.label_maturity(x, "d", "2001-08-01", 90), "rate")


@query("lk10_mature_only", """
select o_orderkey, o_orderdate from orders where epoch_us(timestamp '2001-08-01') - epoch_us(o_orderdate) >= 90 * 86400000000""")
def _(t):
    return L.mature_only(t.orders, "o_orderdate", "2001-08-01", 90).select("o_orderkey", "o_orderdate")


@query("lk11_label_lag", """
with x as (select floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0) as lag
  from lineitem join orders on l_orderkey = o_orderkey)
select count(*) as n, quantile_cont(lag, 0.5) as p50, quantile_cont(lag, 0.9) as p90, max(lag) as max_lag,
  round(avg((lag > 30)::int), 6) as over_cadence from x""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(L.label_lag(j, "o_orderdate", "l_shipdate", 30), "over_cadence")


@query("lk12_gold_set_shift", """
with g as (select lang as stratum, count(*)::double as n from labels join documents using (doc_id) group by 1),
p as (select lang as stratum, count(*)::double as n from documents group by 1),
s as (select stratum, coalesce(g.n, 0) / (select sum(n) from g) as gold, coalesce(p.n, 0) / (select sum(n) from p) as pop
  from g full join p using (stratum))
select stratum, round(gold, 6) as gold, round(pop, 6) as pop, round(gold - pop, 6) as diff,
  round((greatest(gold, 1e-4) - greatest(pop, 1e-4)) * ln(greatest(gold, 1e-4) / greatest(pop, 1e-4)), 6) as psi_part from s""")
def _(t):
    gold = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return rounded(L.gold_set_shift(gold, t.documents, "lang"), "gold", "pop", "diff", "psi_part")


SORTED = """o as (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as r, count(*) over () as n from orders)"""


@query("sp01_temporal_split", f"with {SORTED} select o_orderkey, case when r < floor(n * (1 - 0.2::double)) then 'train' else 'test' end as split from o")
def _(t):
    return S.temporal_split(t.orders, "o_orderdate", "o_orderkey", 0.2).select("o_orderkey", "split")


@query("sp01_temporal_split_ties", """
with e as (select date_trunc('month', ts) as m, user_id % 3 as k from events),
o as (select *, row_number() over (order by m, k) - 1 as r, count(*) over () as n from e)
select m::date as month, k, case when r < floor(n * (1 - 0.2::double)) then 'train' else 'test' end as split, count(*) as n from o group by all""")
def _(t):
    e = t.events.select(F.date_trunc("month", "ts").alias("m"), (F.col("user_id") % 3).alias("k"))
    return S.temporal_split(e, "m", "k").groupBy(F.to_date("m").alias("month"), "k", "split").agg(F.count(F.lit(1)).alias("n"))


@query("sp01_temporal_split_text_key", f"with {SORTED} select case when r < floor(n * (1 - 0.2::double)) then 'train' else 'test' end as split, count(*) as n from o group by 1")
def _(t):
    x = t.orders.withColumn("name", F.concat("o_orderpriority", F.col("o_orderkey").cast("string")))
    return S.temporal_split(x, "o_orderdate", "name").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


HASH32 = "('0x' || substr(md5('{seed}' || {k}::varchar), 1, 8))::bigint"


@query("sp02_random_split", f"""
with o as (select o_orderkey, row_number() over (order by {HASH32.format(seed='7:', k='o_orderkey')} % 2147483647, o_orderkey) - 1 as r,
  count(*) over () as n from orders)
select o_orderkey, case when r < floor(n * (1 - 0.25::double)) then 'train' else 'test' end as split from o""")
def _(t):
    return S.random_split(t.orders, "o_orderkey", 0.25, 7).select("o_orderkey", "split")


@query("sp03_entity_split", f"""
select o_orderkey, o_custkey, case when {HASH32.format(seed='3:', k='o_custkey')} % 10000 < 2000 then 'test' else 'train' end as split
from orders""")
def _(t):
    return S.entity_split(t.orders, "o_custkey", 0.2, 3).select("o_orderkey", "o_custkey", "split")


@query("sp04_temporal_entity_split", """
with x as (select o_orderkey, o_orderdate, case when o_custkey % 4 = 0 and o_orderdate >= timestamp '2000-06-01' then -o_custkey else o_custkey end as o_custkey from orders),
o as (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as r, count(*) over () as n from x),
c as (select *, r < floor(n * (1 - 0.2::double)) as tr from o)
select o_orderkey, case when tr then 'train' when o_custkey in (select o_custkey from c where tr) then 'dropped' else 'test' end as split
from c""")
def _(t):
    late = (F.col("o_custkey") % 4 == 0) & (F.col("o_orderdate") >= F.to_timestamp(F.lit("2000-06-01")))
    x = t.orders.withColumn("o_custkey", F.when(late, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    return S.temporal_entity_split(x, "o_orderdate", "o_orderkey", "o_custkey").select("o_orderkey", "split")


@query("sp05_three_way_split", f"""
with {SORTED}, c as (select *, floor(n * (1 - 0.2::double)) as k from o)
select o_orderkey, case when r >= k then 'test' when r >= floor(k * (1 - 0.15::double)) then 'calibration' else 'train' end as split from c""")
def _(t):
    return S.three_way_split(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query("sp06_contiguous_kfold", """
select event_id, ntile(7) over (order by ts, event_id)::int as fold from events""")
def _(t):
    return S.kfold(t.events, micros("ts"), "event_id", 7).select("event_id", "fold")


@query("sp07_confirmation_holdout", f"with {SORTED} select o_orderkey, case when r < floor(n * (1 - 0.15::double)) then 'build' else 'holdout' end as split from o")
def _(t):
    return S.holdout(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query("sp08_walk_forward", """
with p as (select distinct date_trunc('month', o_orderdate)::date as period from orders),
i as (select period, row_number() over (order by period) - 1 as i, count(*) over () as n from p),
f as (select unnest(range(1, ((max(n) - 24) // 6 + 1)::bigint)) as fold from i)
select fold::int as fold, period, case when i < 24 + (fold - 1) * 6 then 'train' else 'test' end as role
from f join i on i < 24 + fold * 6""")
def _(t):
    return S.walk_forward(periods(t.orders, "o_orderdate", "M"), "period", 24, 6)


@query("sp09_contract", """
with x as (select case when l_linenumber = 7 and l_quantity > 45 then 1 else 0 end as y from lineitem)
select 'y' as target, 'classification' as task, round(avg(y), 6) as positive_rate,
  case when avg(y) < 0.02 then 'average_precision' else 'roc_auc' end as metric, 'auto' as metric_source,
  'temporal-entity-aware' as split_strategy, 42 as seed, 5 as n_folds, 0.15::double as holdout_frac from x""")
def _(t):
    x = t.lineitem.withColumn("y", F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), 1).otherwise(0))
    return S.contract(x, "y", "l_shipdate", "l_orderkey")
