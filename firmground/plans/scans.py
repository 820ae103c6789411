import uuid

from pyspark.sql import functions as F

from firmground.operators.audit import grain_check
from firmground.plans.registry import query
from firmground.session import checkpoint_dir
from firmground.sources import snapshots, tables


@query("sc01_table_scan", """
select event_id, user_id, event_type, value from events""")
def _(t):
    return tables.scan(t.spark, f"{t.folder}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query("sc02_projected_scan", "select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def _(t):
    return tables.scan(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 45")


@query("sc03_parse_dates", """
with x as (select case when event_id % 50 = 0 then 'not a date' when event_id % 77 = 0 then null
                       else strftime(ts, '%Y-%m-%d %H:%M:%S') end as s from events)
select count(*) as n, count(*) filter (s is null) as n_null,
       count(*) filter (s is not null and try_cast(s as timestamp) is null) as n_bad from x""")
def _(t):
    text = F.when(F.col("event_id") % 50 == 0, "not a date").when(F.col("event_id") % 77 == 0, None).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return tables.parse_report(t.events.select(text.alias("s")), "s")


@query("sc05_snapshot_profile", """
select 'orders' as name, count(*) as row_count, 6 as col_count, 'o_orderdate' as time_col,
       min(o_orderdate)::date as min_date, max(o_orderdate)::date as max_date,
       ['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority'] as columns
from orders""")
def _(t):
    return snapshots.snapshot(t.orders, "orders", "2026-01-01").drop("hash", "taken_on")


@query("sc06_snapshot_diff", """
with old as (select 'orders' as name, count(*) as r, max(o_orderdate)::date as m from orders
             where o_orderdate < timestamp '2001-03-01'
             union all select 'customer', count(*), null from customer
             union all select 'gone', count(*), null from region),
new as (select 'orders' as name, count(*) as r, max(o_orderdate)::date as m from orders
        union all select 'customer', count(*), null from customer),
j as (select name, o.r as orr, n.r as nrr, o.m as om, n.m as nm, abs(n.r - o.r) / o.r::double as ch
      from old o full join new n using (name))
select name, 'missing' as type, 'no current snapshot' as detail, 'error' as severity from j where nrr is null
union all select name, 'rowcount_drift', orr || ' -> ' || nrr, case when ch < 0.1 then 'warning' else 'error' end
  from j where ch > 0.05
union all select name, 'time_range_change', om || ' -> ' || nm, 'info' from j where om <> nm
union all select name, 'content_changed', 'content hash differs', 'info' from j where orr <> nrr
union all select name, 'stale', 'taken on 2026-01-01', 'warning' from j where orr is not null""")
def _(t):
    def snap(df, name):
        return snapshots.snapshot(df, name, "2026-01-01")

    old = snap(t.orders.where(F.col("o_orderdate") < F.to_timestamp(F.lit("2001-03-01"))), "orders").unionByName(
        snap(t.customer, "customer")).unionByName(snap(t.region, "gone"))
    new = snap(t.orders, "orders").unionByName(snap(t.customer, "customer"))
    return snapshots.snapshot_diff(old, new, 0.05, today="2026-03-01")


@query("sc04_result_sink", """
with k as (select o_custkey, count(*) as c from orders group by 1), g as (select sum(c)::bigint as rows, count(*) as uniques, sum(c - 1)::bigint as dup_rows from k)
select f as fmt, rows, uniques, dup_rows from g, (select unnest(['parquet', 'json', 'csv', 'orc']) as f)""")
def _(t):
    found = grain_check(t.orders, ["o_custkey"]).select("rows", "uniques", "dup_rows")
    base = f"{checkpoint_dir(t.spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    out = None
    for fmt in ("parquet", "json", "csv", "orc"):
        path = tables.write(found, f"{base}/{fmt}", fmt)
        back = tables.scan(t.spark, path, ["rows", "uniques", "dup_rows"], fmt=fmt, schema=found.schema).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out
