"""The relational primitives the checks are made of, each as one plain query."""
from pyspark.sql import Window, functions as F

from firmground.functions.columns import md5_bucket, micros
from firmground.functions.ordering import CHUNK, framed, quantiles, running, value_counts
from firmground.operators.audit import missing_periods, pair_correlations
from firmground.operators.signal import filled
from firmground.operators.splits import kfold, random_split
from firmground.plans.registry import query
from firmground.plans.scores import rounded

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("rl01_computed_column", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 6) as net,
  case when l_quantity >= 25 then 'large' else 'small' end as size from lineitem""")
def _(t):
    return t.lineitem.select(*ROW, F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"),
                             F.when(F.col("l_quantity") >= 25, "large").otherwise("small").alias("size"))


@query("rl02_filter_dropna", """
select event_id, nullif(event_type, 'error') as kind from events where value > 20 and event_type <> 'error'""")
def _(t):
    return t.events.where("value > 20").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind")).dropna(subset=["kind"])


@query("rl03_impute_median", """
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber = 2 then null else l_quantity end as q from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(q, (select quantile_cont(q, 0.5) from x)) as q_median, coalesce(q, -1) as q_flag from x""")
def _(t):
    x = t.lineitem.select(*ROW, F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q")).withColumn(
        "q_flag", F.coalesce("q", F.lit(-1.0)))
    return filled(x, ["q"]).withColumnRenamed("q", "q_median")


@query("rl04_inner_join", """
select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey group by 1""")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rl05_left_join_nulls", """
select count(*) as n_rows, count(*) filter (quality is null) as unmatched from documents left join labels using (doc_id)""")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quality").isNull()).alias("unmatched"))


@query("rl06_semi_anti", """
select 'labelled' as side, count(*) as n from documents where doc_id in (select doc_id from labels)
union all select 'unlabelled', count(*) from documents where doc_id not in (select doc_id from labels)""")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("labelled").alias("side"), "n").unionByName(
        t.documents.join(t.labels, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unlabelled").alias("side"), "n"))


@query("rl07_key_sets", """
(select user_id as k, 'both' as side from events intersect select l_suppkey, 'both' from lineitem)
union all (select distinct l_suppkey, 'right_only' from lineitem where l_suppkey not in (select user_id from events))""")
def _(t):
    a = t.events.select(F.col("user_id").alias("k"))
    b = t.lineitem.select(F.col("l_suppkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(b.distinct().join(a, "k", "left_anti").withColumn("side", F.lit("right_only")))


@query("rl08_union_all", """
select source, count(*) as n from (select 'doc' as source, text from documents union all select 'chat', text from conversations
  union all select 'item', text from benchmark) group by 1""")
def _(t):
    both = t.documents.select(F.lit("doc").alias("source"), "text").unionByName(
        t.conversations.select(F.lit("chat").alias("source"), "text")).unionByName(t.benchmark.select(F.lit("item").alias("source"), "text"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("rl09_domain_union", """
with a as (select p_size as v, count(*) as na from part where p_partkey % 2 = 0 group by 1),
b as (select p_size + 10 as v, count(*) as nb from part where p_partkey % 2 = 1 group by 1)
select v, coalesce(na, 0) as na, coalesce(nb, 0) as nb from a full join b using (v)""")
def _(t):
    a = t.part.where("p_partkey % 2 = 0").groupBy(F.col("p_size").alias("v")).agg(F.count(F.lit(1)).alias("na"))
    b = t.part.where("p_partkey % 2 = 1").groupBy((F.col("p_size") + 10).alias("v")).agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "v", "full_outer").fillna(0, ["na", "nb"])


@query("rl10_duplicated", """
with k as (select o_custkey, o_orderdate, count(*) as c from orders group by all) select count(*) as distinct_rows, sum(c - 1)::bigint as duplicates from k""")
def _(t):
    return t.orders.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.col("c") - 1).alias("duplicates"))


@query("rl11_group_aggregate", """
select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max from events group by 1""")
def _(t):
    g = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                           F.min("value").alias("min"), F.max("value").alias("max"))
    return rounded(g, "mean", "std")


@query("rl12_value_counts", """
with x as (select nullif(lang, 'es') as lang from documents) select lang, count(*) as n, round(count(*) / (select count(*) from x)::double, 6) as share from x group by 1""")
def _(t):
    x = t.documents.select(F.nullif("lang", F.lit("es")).alias("lang"))
    counts = x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / x.agg(F.count(F.lit(1))).scalar(), 6))


@query("rl13_count_distinct", "select count(distinct user_id) as users, count(distinct event_type) as kinds from events")
def _(t):
    return t.events.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("rl14_exact_quantiles", """
select 'l_extendedprice' as "column", count(*) as n, round(quantile_cont(l_extendedprice, 0.1), 4) as q0, round(quantile_cont(l_extendedprice, 0.5), 4) as q1,
  round(quantile_cont(l_extendedprice, 0.99), 4) as q2 from lineitem
union all select 'l_quantity', count(*), quantile_cont(l_quantity, 0.1), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.99) from lineitem""")
def _(t):
    return rounded(quantiles(t.lineitem, ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.99]), "q0", "q1", "q2", n=4)


@query("rl15_width_bins", """
select case when value >= 500 then 9 else floor(value / 50)::int end as bin, count(*) as n from events group by 1""")
def _(t):
    return t.events.groupBy(F.least(F.floor(F.col("value") / 50), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("rl16_lag_difference", """
select event_id, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as step from events""")
def _(t):
    def step(df, part):
        w = Window.partitionBy(*part).orderBy("_at", "event_id")
        return df.withColumn("step", F.round(F.col("value") - F.lag("value").over(w), 6))

    return framed(t.events.withColumn("_at", micros("ts")), "user_id", ["_at", "event_id"], step).select("event_id", "step")


@query("rl17_equal_slices", """
with s as (select c_custkey, ntile(4) over (order by round(c_acctbal * 100)::bigint, c_custkey)::int as part from customer)
select part, count(*) as n, min(c_custkey) as first_key, max(c_custkey) as last_key from s group by 1""")
def _(t):
    s = kfold(t.customer, F.round(F.col("c_acctbal") * 100).cast("bigint"), "c_custkey", 4, "part")
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


@query("rl18_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("rl19_group_top_k", """
select user_id, event_id, value from events qualify row_number() over (partition by user_id order by abs(value) desc, event_id) <= 3""")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc(F.abs("value")), "event_id")
    return t.events.withColumn("_r", F.row_number().over(w)).where("_r <= 3").select("user_id", "event_id", "value")


@query("rl20_correlation", "select 'l_quantity' as col_a, 'l_extendedprice' as col_b, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def _(t):
    return rounded(pair_correlations(t.lineitem, {"l_quantity": F.col("l_quantity"), "l_extendedprice": F.col("l_extendedprice")}), "r")


@query("rl21_period_truncation", "select date_trunc('quarter', o_orderdate)::date as quarter, count(*) as n from orders group by 1")
def _(t):
    return t.orders.groupBy(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("rl22_date_spine", """
select period from (select unnest(generate_series(min(ts)::date::timestamp, max(ts)::date::timestamp, interval 1 day))::date as period from events where day(ts) % 3 = 0)
where day(period) % 3 <> 0""")
def _(t):
    return missing_periods(t.events.where(F.day("ts") % 3 == 0), "ts", "D")


@query("rl23_seeded_shuffle", """
with o as (select doc_id, row_number() over (order by ('0x' || substr(md5('11:' || doc_id::varchar), 1, 8))::bigint % 2147483647, doc_id) - 1 as r, count(*) over () as n from documents)
select doc_id, case when r < floor(n * (1 - 0.5::double)) then 'train' else 'test' end as split from o""")
def _(t):
    return random_split(t.documents, "doc_id", 0.5, 11).select("doc_id", "split")


@query("rl24_regex", r"""
select page_id, regexp_matches(html, '<script') as has_script, len(regexp_extract_all(html, 'href="[^"]*"'))::int as links from pages""")
def _(t):
    return t.pages.select("page_id", F.col("html").rlike("<script").alias("has_script"),
                          F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).alias("links"))


@query("rl25_hash", "select doc_id, md5(text) as digest, ('0x' || substr(md5('k' || doc_id::varchar), 1, 8))::bigint % 64 as bucket from documents".replace("% 64 as", "% 64)::int as").replace("('0x'", "(('0x'"))
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("digest"), md5_bucket("doc_id", 64, "k").alias("bucket"))


@query("rl26_scalar_math", """
select vec_id, round(sqrt(list_sum([x::double * x for x in embedding])), 4) as norm, round(ln(1 + abs(embedding[1]::double)), 6) as lg,
  greatest(-0.1, least(0.1, round(embedding[2]::double, 6))) as clipped from embeddings""")
def _(t):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return t.embeddings.select(
        "vec_id", F.round(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), 4).alias("norm"),
        F.round(F.log(1 + F.abs(x[0])), 6).alias("lg"), F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.round(x[1], 6))).alias("clipped"))


@query("rl_prefix_sums", """
with c as (select l_extendedprice as value, count(*) as n from lineitem group by 1)
select value, n, (sum(n) over (order by value))::bigint as upto from c""")
def _(t):
    counts = value_counts(t.lineitem, ["l_extendedprice"])
    return running(counts, ["value"], {"upto": ("sum", "n")}, chunk_col=CHUNK).select("value", "n", "upto")
