"""Audit and signal queries."""
from pyspark.sql import functions as F

from firmground.operators import audit as A, signal as S
from firmground.plans.registry import query
from firmground.plans.scores import rounded


@query("au01_grain_check", """
with k as (select l_orderkey, l_linenumber, count(*) as c from lineitem group by all)
select sum(c)::bigint as rows, count(*) as uniques, sum(c - 1)::bigint as dup_rows,
       round(sum(c - 1) / sum(c), 6) as dup_rate, sum(c - 1) = 0 as passed from k""")
def _(t):
    return rounded(A.grain_check(t.lineitem, ["l_orderkey", "l_linenumber"]), "dup_rate")


@query("au02_candidate_keys", """
select * from (select unnest([case when count(distinct event_id) = count(*) then 'event_id' end,
               case when count(distinct ts) = count(*) then 'ts' end,
               case when count(distinct user_id) = count(*) then 'user_id' end,
               case when count(distinct value) = count(*) then 'value' end]) as "column" from events)
where "column" is not null""")
def _(t):
    return A.candidate_keys(t.events)


EV = """x as (select event_id, nullif(event_type, 'error') as event_type, case when event_id % 7 = 0 then null else value end as value,
  case when event_id % 7 = 0 or event_id % 11 = 0 then null else props end as props, user_id from events)"""


def holed(t):
    gone = F.col("event_id") % 7 == 0
    return t.events.select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(~gone, F.col("value")).alias("value"),
        F.when(~(gone | (F.col("event_id") % 11 == 0)), F.col("props")).alias("props"), "user_id")


@query("au03_null_rates", f"""
with {EV}, r as (select unnest(['event_type','value','props']) as "column", unnest([
  avg(case when event_type is null then 1 else 0 end), avg(case when value is null then 1 else 0 end),
  avg(case when props is null then 1 else 0 end)]) as r from x)
select "column", round(r, 6) as null_rate from r where r > 0""")
def _(t):
    return rounded(A.null_rates(holed(t)), "null_rate")


@query("au04_null_corr", f"""
with {EV}, i as (select (event_type is null)::int as a, (value is null)::int as b, (props is null)::int as c from x),
r as (select unnest(['event_type','event_type','value']) as col_a, unnest(['value','props','props']) as col_b,
  unnest([corr(a, b), corr(a, c), corr(b, c)]) as r from i)
select col_a, col_b, round(r, 6) as r from r where abs(r) > 0.5""")
def _(t):
    return rounded(A.null_corr(holed(t)), "r")


@query("au05_target_counts", """
select o_orderstatus as value, count(*) as n, round(count(*) / (select count(*) from orders)::double, 6) as share
from orders group by 1 order by n desc, value limit 10""")
def _(t):
    return rounded(A.target_counts(t.orders, "o_orderstatus"), "share")


@query("au06_minority_rate", """
with c as (select toxic, count(*) as n from labels group by 1)
select round(min(n) / sum(n), 6) as minority_rate, min(n) / sum(n) < 0.1 as imbalanced from c having count(*) = 2""")
def _(t):
    return rounded(A.minority_rate(t.labels, "toxic"), "minority_rate")


@query("au07_target_summary", """
select round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, min(value) as min,
       round(quantile_cont(value, 0.5), 4) as p50, max(value) as max, round(skewness(value), 4) as skew,
       abs(skewness(value)) > 1 as heavy from events""")
def _(t):
    return rounded(A.target_summary(t.events, "value"), "mean", "std", "p50", "skew", n=4)


@query("au08_time_coverage", """
select min(o_orderdate)::date as min_date, max(o_orderdate)::date as max_date,
       datediff('day', min(o_orderdate), max(o_orderdate))::int as days, 0::bigint as n_bad from orders""")
def _(t):
    return A.time_coverage(t.orders, "o_orderdate")


@query("au09_missing_periods", """
with h as (select distinct o_orderdate::date as d from orders where dayofyear(o_orderdate) % 9 <> 0),
s as (select unnest(generate_series(min(d)::timestamp, max(d)::timestamp, interval 1 day))::date as period from h)
select period from s where period not in (select d from h)""")
def _(t):
    return A.missing_periods(t.orders.where(F.dayofyear("o_orderdate") % 9 != 0), "o_orderdate", "D")


@query("au10_volume_cv", """
with p as (select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by 1)
select count(*) as periods, round(stddev_samp(n) / avg(n), 6) as cv, stddev_samp(n) / avg(n) > 0.5 as uneven from p""")
def _(t):
    return rounded(A.volume_cv(t.orders, "o_orderdate", "M"), "cv")


@query("au11_elapsed_profile", """
with x as (select event_id, event_id % 97 as lane, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as x from events),
l as (select x < lag(x) over (order by lane, event_id) as d from x),
e as (select count(*) as n, min(x) as lo, max(x) as hi from x),
b as (select greatest(ceil((x - lo) / ((hi - lo) / 10)) - 1, 0) as b, count(*)::double as c from x, e group by 1),
v as (select sqrt((sum(c * c) - sum(c) * sum(c) / 10) / 9) / (sum(c) / 10) as cv from b)
select e.n as rows, round(hi - lo, 4) as span, (select count(*) from l where d) as reversals,
  round((select count(*) filter (d) / count(d)::double from l), 6) as reversal_rate, round(cv, 6) as cv,
  round(q[1], 4) as p01, round(q[2], 4) as p25, round(q[3], 4) as p50, round(q[4], 4) as p75, round(q[5], 4) as p99
from e, v, (select quantile_cont(x, [0.01, 0.25, 0.5, 0.75, 0.99]) as q from x)""")
def _(t):
    start = 1704067200000000
    x = t.events.select("event_id", (F.col("event_id") % 97).alias("lane"), (
        (F.unix_micros(F.col("ts").cast("timestamp")) - start) / F.lit(1e6)).alias("x"))
    out = A.elapsed_profile(x, "x", ["lane", "event_id"])
    return rounded(rounded(out, "reversal_rate", "cv"), "span", "p01", "p25", "p50", "p75", "p99", n=4)


@query("au12_is_elapsed", """
select min(year(to_timestamp(value))) >= 1969 and max(year(to_timestamp(value))) < 1971 as is_elapsed from events""")
def _(t):
    return A.is_elapsed(t.events, "value")


LINK = """
with l as (select {lk} as k, count(*) as l from {lt} group by 1), r as (select {rk} as k, count(*) as r from {rt} group by 1),
j as (select l.l, r.r from l full join r using (k))
select count(l) as l_keys, count(r) as r_keys, count(*) filter (l is not null and r is not null) as matched,
  count(*) filter (r is null) as l_only, count(*) filter (l is null) as r_only,
  round(count(*) filter (l is not null and r is not null) / count(l)::double, 6) as l_rate,
  round(count(*) filter (l is not null and r is not null) / count(r)::double, 6) as r_rate,
  case when sum(l - 1) > 0 then 'many' else 'one' end || ':' || case when sum(r - 1) > 0 then 'many' else 'one' end as cardinality,
  sum(l - 1)::bigint as l_repeats, sum(r - 1)::bigint as r_repeats, sum(l * r)::bigint as join_rows,
  sum(l - 1) > 0 and sum(r - 1) > 0 as explodes from j"""


@query("au13_linkage", LINK.format(lk="o_custkey", lt="orders", rk="c_custkey", rt="customer"))
def _(t):
    return rounded(A.linkage(t.orders, t.customer, "o_custkey", "c_custkey"), "l_rate", "r_rate")


@query("au14_join_cardinality", LINK.format(lk="l_suppkey", lt="lineitem", rk="user_id", rt="events"))
def _(t):
    return rounded(A.linkage(t.lineitem, t.events, "l_suppkey", "user_id"), "l_rate", "r_rate")


@query("au15_join_rows_check", """
select sum(l * r)::bigint as expected, (select count(*) from lineitem join part on l_partkey = p_partkey) as actual,
  sum(l * r) = (select count(*) from lineitem join part on l_partkey = p_partkey) as passed
from (select l_partkey as k, count(*) as l from lineitem group by 1) join
     (select p_partkey as k, count(*) as r from part group by 1) using (k)""")
def _(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return A.join_rows_check(t.lineitem, t.part, "l_partkey", "p_partkey", joined)


SIG = """s as (select case when l_returnflag = 'R' then 1 else 0 end as y, l_quantity, l_extendedprice, l_discount,
  case when l_linenumber % 5 = 0 then null else l_tax end as l_tax,
  case when l_returnflag = 'R' then 1.0::double else 0.0::double end * 2 + l_tax / 100 as planted, l_linestatus,
  case when l_suppkey % 10 = 0 then null else l_returnflag end as flag_copy from lineitem)"""


def signal_frame(t):
    yes = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return t.lineitem.select(
        yes.alias("y"), "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")).alias("l_tax"),
        (yes * F.lit(2.0) + F.col("l_tax") / 100).alias("planted"), "l_linestatus",
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_returnflag")).alias("flag_copy"))


CORRS = """m as (select median(l_tax) as mt from s), c as (
select unnest(['l_quantity','l_extendedprice','l_discount','l_tax','planted']) as "column",
  unnest([abs(corr(l_quantity, y)), abs(corr(l_extendedprice, y)), abs(corr(l_discount, y)),
          abs(corr(coalesce(l_tax, mt), y)), abs(corr(planted, y))]) as score from s, m)"""


@query("au16_numeric_signal", f'with {SIG}, {CORRS} select "column", round(score, 6) as score from c')
def _(t):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "planted"]
    return rounded(S.numeric_signal(signal_frame(t), "y", cols), "score")


@query("au17_auc_signal", f"""
with {SIG}, m as (select median(l_tax) as mt from s),
u as (select 'l_quantity' as "column", l_quantity as v, y from s union all select 'l_discount', l_discount, y from s
      union all select 'l_tax', coalesce(l_tax, mt), y from s, m union all select 'planted', planted, y from s),
c as (select "column", v, sum(y) as p, sum(1 - y) as n from u group by all),
r as (select *, sum(n) over (partition by "column" order by v) - n as nb from c)
select "column", round(2 * abs(sum(p::double * (nb + n / 2.0)) / (sum(p)::double * sum(n)) - 0.5), 6) as score
from r group by 1""")
def _(t):
    return rounded(S.auc_signal(signal_frame(t), "y", ["l_quantity", "l_discount", "l_tax", "planted"]), "score")


MI = """u as (select 'l_linestatus' as "column", l_linestatus as v, y from s union all
  select 'flag_copy', coalesce(flag_copy, '__missing__'), y from s),
j as (select "column", v, y, count(*)::double as n from u group by all),
w as (select *, sum(n) over (partition by "column", v) as nx, sum(n) over (partition by "column", y) as ny,
        sum(n) over (partition by "column") as nn from j),
mi as (select "column", sum(n / nn * ln(n * nn / (nx * ny))) as score from w group by 1),
hx as (select "column", -sum(nx / nn * ln(nx / nn)) as h from (select distinct "column", v, nx, nn from w) group by 1),
hy as (select "column", -sum(ny / nn * ln(ny / nn)) as h from (select distinct "column", y, ny, nn from w) group by 1)"""


@query("au18_mutual_information", f"""
with {SIG}, {MI} select "column", round(score, 6) as score, round(score / sqrt(hx.h * hy.h), 6) as normalized
from mi join hx using ("column") join hy using ("column")""")
def _(t):
    return rounded(S.mutual_information(signal_frame(t), "y", ["l_linestatus", "flag_copy"]), "score", "normalized")


@query("au19_signal_ranking", f"""
with {SIG}, {CORRS}, {MI}
select "column", 'numeric' as kind, 'corr' as method, round(score, 6) as score, score >= 0.98 as leak_suspect from c
union all select "column", 'categorical', 'mi', round(score, 6), false from mi""")
def _(t):
    return rounded(S.signal(signal_frame(t), "y"), "score")


RANGE = """q as (select quantile_cont({c}, [0.25, 0.5, 0.75]) as q, min({c}) as lo, max({c}) as hi, count({c}) as n from {t})
select '{c}' as "column", 'outliers' as finding, round(q[3] - q[1], 4) as value,
  (select count(*) from {t}, q where {c} < q[1] - 3 * (q[3] - q[1]) or {c} > q[3] + 3 * (q[3] - q[1])) as n,
  round((select count(*) from {t}, q where {c} < q[1] - 3 * (q[3] - q[1]) or {c} > q[3] + 3 * (q[3] - q[1])) / n::double, 6) as rate,
  lo as min, round(q[2], 4) as p50, hi as max from q"""


@query("au20_outlier_fence", "with " + RANGE.format(c="value", t="events"))
def _(t):
    out = A.range_check(t.events, ["value"]).where("finding = 'outliers'")
    return rounded(rounded(out, "rate"), "value", "p50", n=4)


@query("au21_negative_counts", """
with x as (select l_quantity - 5 as net_quantity from lineitem)
select 'net_quantity' as "column", 'negative' as finding, min(net_quantity) as value,
  count(*) filter (net_quantity < 0) as n, round(count(*) filter (net_quantity < 0) / count(*)::double, 6) as rate,
  min(net_quantity) as min, quantile_cont(net_quantity, 0.5) as p50, max(net_quantity) as max from x""")
def _(t):
    out = A.range_check(t.lineitem.select((F.col("l_quantity") - 5).alias("net_quantity")))
    return rounded(out.where("finding = 'negative'"), "rate")


@query("au22_sentinel_rate", """
with x as (select case when p_partkey % 20 = 0 then -999 when p_partkey % 33 = 0 then 9999 else p_size end as size_code from part)
select 'size_code' as "column", 'sentinel' as finding, s::double as value, count(*) filter (size_code = s) as n,
  round(count(*) filter (size_code = s) / count(*)::double, 6) as rate, min(size_code)::double as min,
  quantile_cont(size_code, 0.5)::double as p50, max(size_code)::double as max
from x, (select unnest([-1, -999, 999, 9999, 99999, 999999]) as s) group by s
having count(*) filter (size_code = s) > 0.01 * count(*)""")
def _(t):
    key = F.col("p_partkey")
    code = F.when(key % 20 == 0, -999).when(key % 33 == 0, 9999).otherwise(F.col("p_size"))
    out = A.range_check(t.part.select(code.alias("size_code"))).where("finding = 'sentinel'")
    return rounded(out, "rate")


def planted(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("l_quantity").alias("qty_copy"), F.lit(1).alias("always_one"),
        F.when(F.col("l_orderkey") % 1000 == 0, 1).otherwise(0).alias("nearly_zero"),
        F.when(F.col("l_orderkey") % 50 == 0, F.col("l_tax")).alias("hollow"),
        "l_linestatus", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PLANTED = """pl as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
 l_quantity as qty_copy, 1 as always_one, case when l_orderkey % 1000 = 0 then 1 else 0 end as nearly_zero,
 case when l_orderkey % 50 = 0 then l_tax end as hollow, l_linestatus,
 case when l_returnflag = 'R' then 1 else 0 end as y from lineitem)"""


@query("au23_duplicate_columns", f"""
with {PLANTED}, names as (select unnest(['l_quantity','l_extendedprice','l_discount','l_tax','qty_copy']) as c)
select 'qty_copy' as "column", 'l_quantity' as duplicate_of from pl having bool_and(qty_copy is not distinct from l_quantity)
union all select 'l_tax', 'l_discount' from pl having bool_and(l_tax is not distinct from l_discount)
union all select 'l_discount', 'l_quantity' from pl having bool_and(l_discount is not distinct from l_quantity)""")
def _(t):
    found = A.duplicate_columns(planted(t), KEYS)
    return t.spark.createDataFrame(found, '`column` string, duplicate_of string')


@query("au24_near_constant", f"""
with {PLANTED}, u as (unpivot (select always_one::varchar as always_one, nearly_zero::varchar as nearly_zero,
  l_quantity::varchar as l_quantity, l_linestatus::varchar as l_linestatus from pl) on columns(*) into name c value v),
n as (select c, v, count(*) as n from u group by all)
select c as "column", round(max(n) / sum(n), 6) as top_share, max(n) / sum(n) >= 0.99 as near_constant from n group by c""")
def _(t):
    return rounded(A.near_constant(planted(t), ["always_one", "nearly_zero", "l_quantity", "l_linestatus"]), "top_share")


@query("au25_task_type", """
select 'o_orderstatus' as target, 'classification' as task union all
select 'l_linenumber', case when count(distinct l_linenumber) <= 20 then 'classification' else 'regression' end from lineitem
union all
select 'o_totalprice', case when count(distinct o_totalprice) <= 20 then 'classification' else 'regression' end from orders""")
def _(t):
    return (A.task_type(t.orders, "o_orderstatus").withColumn("target", F.lit("o_orderstatus"))
            .unionByName(A.task_type(t.lineitem, "l_linenumber").withColumn("target", F.lit("l_linenumber")))
            .unionByName(A.task_type(t.orders, "o_totalprice").withColumn("target", F.lit("o_totalprice"))))


def _triage_sql():
    cols = [("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
            ("qty_copy", "double"), ("always_one", "int"), ("nearly_zero", "int"), ("hollow", "double")]
    rows = " union all ".join(
        f"select {i} as i, '{c}' as c, '{k}' as dt, {c}::double as v, {c}::varchar as s, y from pl"
        for i, (c, k) in enumerate(cols)) + " union all select 8, 'l_linestatus', 'string', null, l_linestatus, y from pl"
    return f"""
with {PLANTED}, u as ({rows}),
vc as (select i, c, dt, s, count(*) as n from u group by all),
st as (select i, c, dt, sum(n) as n, max(n) as top, count(s) as cardinality, sum(case when s is null then n else 0 end) as nulls
       from vc group by all),
med as (select c, median(v) as m from u group by c),
f as (select u.c, coalesce(v, m) as v, sum(y) as p, sum(1 - y) as q from u join med using (c) group by all),
r as (select *, sum(q) over (partition by c order by v) - q as qb from f where c <> 'l_linestatus'),
a as (select c, 2 * abs(sum(p::double * (qb + q / 2.0)) / (sum(p)::double * sum(q)) - 0.5) as auc from r group by c),
cr as (select abs(corr(hollow, y)) as hc from pl),
x as (select c, dt, round(nulls / n, 4) as null_rate, cardinality, top >= 0.99 * n as is_constant,
  case when c = 'qty_copy' then 'l_quantity' else '' end as dup,
  case when c = 'l_linestatus' then 0.0::double when nulls >= 0.95 * n then round(hc, 4) else round(auc, 4) end as s
  from st left join a using (c), cr),
q as (select quantile_cont(s, 0.9) as cut from x)
select c as "column", 'main' as source, dt as dtype, null_rate, cardinality, is_constant, dup as is_duplicate_of,
  s as univariate_signal,
  case when is_constant or null_rate >= 0.95 or dup <> '' then 'DROP-CANDIDATE'
       when s >= cut and cut > 0 then 'HIGH-SIGNAL'
       when s > 0.01 and c in ('l_discount', 'l_tax', 'nearly_zero', 'hollow', 'always_one', 'l_quantity', 'qty_copy')
       then 'NEEDS-DOMAIN-INPUT' else 'LOW-PRIORITY' end as triage_bucket from x, q"""


@query("au26_column_triage", _triage_sql())
def _(t):
    return S.triage(planted(t), "y", KEYS)


@query("au29_linkage_density", """
select round(avg(case when nullif(event_type, 'error') is null then 0 else 1 end), 6) as density from events""")
def _(t):
    return rounded(A.linkage_density(holed(t), "event_type"), "density")


@query("au30_event_density", """
with n as (select user_id, count(ts) as n from events group by 1)
select count(*) as entities, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as min, max(n) as max,
  quantile_cont(n, 0.25)::double as p25, quantile_cont(n, 0.5)::double as p50, quantile_cont(n, 0.75)::double as p75 from n""")
def _(t):
    return rounded(A.event_density(t.events, "user_id", "ts"), "mean", "std")


@query("au31_window_coverage", """
select floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0)::int as days,
  floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) >= 28 as passed from events""")
def _(t):
    return A.window_coverage(t.events, "ts", 28)


@query("au32_cohort_size", """
with s as (select c_mktsegment, count(*) as n from customer group by 1)
select min(n) as smallest, min(n) >= 20 as passed from s""")
def _(t):
    return A.cohort_size(t.customer, "c_mktsegment")


@query("au33_corr_matrix", """
with x as (select unnest(['l_quantity','l_quantity','l_quantity','l_extendedprice','l_extendedprice','l_discount']) as col_a,
 unnest(['l_extendedprice','l_discount','l_tax','l_discount','l_tax','l_tax']) as col_b,
 unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_quantity, l_tax),
         corr(l_extendedprice, l_discount), corr(l_extendedprice, l_tax), corr(l_discount, l_tax)]) as r from lineitem)
select col_a, col_b, round(r, 6) as r, abs(r) > 0.7 as high from x""")
def _(t):
    return rounded(A.corr_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r")


HOLED = """e as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as k from embeddings),
h as (select vec_id, k, case when (vec_id * 7 + k * 13) % 11 > 0 then v end as v from e)"""


def dimensions(t, holes=True):
    """A wide table, one column per dimension, with a rule for what is unknown."""
    known = lambda k: F.pmod(F.col("vec_id") * 7 + k * 13, F.lit(11)) > 0
    return t.embeddings.select("vec_id", *[F.when(known(k), F.col("embedding")[k].cast("double")).alias(f"d{k:02d}") for k in range(64)])


@query("au33_corr_matrix_wide", f"""with {HOLED}
select 'd' || lpad(a.k::varchar, 2, '0') as col_a, 'd' || lpad(b.k::varchar, 2, '0') as col_b, round(corr(a.v, b.v), 6) as r, abs(corr(a.v, b.v)) > 0.7 as high
from h a join h b on a.vec_id = b.vec_id and a.k < b.k and a.v is not null and b.v is not null group by a.k, b.k""")
def _(t):
    wide = dimensions(t)
    return rounded(A.corr_matrix(wide, wide.columns[1:]), "r")


@query("au04_null_corr_wide", f"""with {HOLED}
select 'd' || lpad(a.k::varchar, 2, '0') as col_a, 'd' || lpad(b.k::varchar, 2, '0') as col_b, round(corr((a.v is null)::int, (b.v is null)::int), 6) as r
from h a join h b on a.vec_id = b.vec_id and a.k < b.k group by a.k, b.k having abs(corr((a.v is null)::int, (b.v is null)::int)) > 0.5""")
def _(t):
    return rounded(A.null_corr(dimensions(t).drop("vec_id")), "r")


@query("au02_candidate_keys_wide", """
select * from (select unnest([case when count(distinct o_orderkey) = count(*) then 'o_orderkey' end,
  case when count(distinct o_totalprice) = count(*) then 'o_totalprice' end, case when count(distinct o_orderkey // 2) = count(*) then 'pairs' end,
  case when count(distinct case when o_orderkey > 0 then o_orderkey end) + 1 = count(*) then 'one_null' end]) as "column" from orders) where "column" is not null""")
def _(t):
    return A.candidate_keys(t.orders.select("o_orderkey", "o_totalprice", F.floor(F.col("o_orderkey") / 2).alias("pairs"),
                                            F.when(F.col("o_orderkey") > 0, F.col("o_orderkey")).alias("one_null"), "o_orderstatus", "o_custkey"))


@query("au26_triage_counts", "with r as (" + _triage_sql() + """)
select triage_bucket, count(*) as n from r group by 1""")
def _(t):
    return S.triage_counts(S.triage(planted(t), "y", KEYS))


@query("au34_class_conditional", """
with u as (select l_returnflag as class, 'l_quantity' as feature, l_quantity as v from lineitem
           union all select l_returnflag, 'l_extendedprice', l_extendedprice from lineitem),
q as (select class, feature, count(v) as n, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from u group by all)
select class, feature, n, round(q[1], 4) as q05, round(q[2], 4) as q25, round(q[3], 4) as q50, round(q[4], 4) as q75,
  round(q[5], 4) as q95 from q""")
def _(t):
    return rounded(A.class_conditional(t.lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag"),
                   "q05", "q25", "q50", "q75", "q95", n=4)


@query("au34_class_histogram", """
with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select l_returnflag as class, least(floor((l_extendedprice - lo) * 10 / (hi - lo)), 9)::int as bin, count(*) as n
from lineitem, e group by all""")
def _(t):
    return A.class_histogram(t.lineitem, "l_extendedprice", "l_returnflag")


@query("au35_small_cells", """
with g as (select lang, source, count(*) as n, sum(n_chars)::bigint as chars from documents group by all)
select lang, source, n, chars, null::bigint as suppressed_groups from g where n >= 8
union all select null, null, sum(n)::bigint, null, count(*) from g where n < 8 having count(*) > 0""")
def _(t):
    g = t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return A.suppress(g, ["lang", "source"], "n", ["chars"], 8)


def _pii_sql(table, col):
    parts = [f"""select '{col}' as "column", '{kind}' as kind,
  count(*) filter (len(regexp_extract_all({col}, '{pat}')) > 0) as n_rows,
  coalesce(sum(len(regexp_extract_all({col}, '{pat}'))), 0)::bigint as hits from {table}""" for kind, pat in A.PII.items()]
    return " union all ".join(parts)


@query("au36_pii_scan", _pii_sql("documents", "text"))
def _(t):
    return A.pii_scan(t.documents, ["text"])


@query("au36_pii_scan_chats", _pii_sql("conversations", "text"))
def _(t):
    return A.pii_scan(t.conversations, ["text"])


@query("au37_base_rate", "select round(avg(quality), 6) as rate, round(greatest(avg(quality), 1 - avg(quality)), 6) as majority from labels")
def _(t):
    return rounded(A.base_rate(t.labels, "quality"), "rate", "majority")
