"""Funnel queries on a wide frame with planted columns."""
import uuid

from pyspark.sql import functions as F

from firmground.functions.columns import micros
from firmground.operators import funnel as N, metrics as M
from firmground.plans.registry import query
from firmground.plans.scored import PRED, predictions
from firmground.plans.scores import rounded
from firmground.session import checkpoint_dir

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CANDS = ["l_quantity", "final_flag", "leak", "l_extendedprice", "l_discount", "rare_flag", "qty_dup", "hollow",
         "high_card", "p_brand", "p_size", "s_acctbal", "price_scaled", "l_tax"]
FRAME = """w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  case when l_returnflag = 'R' then 1 else 0 end as y, l_quantity, l_extendedprice, l_discount, l_tax,
  case when l_returnflag = 'R' then 1 else 0 end as final_flag,
  case when l_returnflag = 'R' then 3.0::double else 0.0::double end + l_tax / 1000 as leak,
  case when l_orderkey % 500 = 0 then 1 else 0 end as rare_flag, l_quantity as qty_dup,
  case when l_orderkey % 10 = 0 then l_tax end as hollow, 'K' || l_partkey as high_card, p_brand, p_size, s_acctbal,
  l_extendedprice * 1.1::double + l_tax as price_scaled
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""


def wide(t):
    yes = F.col("l_returnflag") == "R"
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        *KEY, "l_shipdate", F.when(yes, 1).otherwise(0).alias("y"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.when(yes, 1).otherwise(0).alias("final_flag"),
        (F.when(yes, 3.0).otherwise(0.0) + F.col("l_tax") / 1000).alias("leak"),
        F.when(F.col("l_orderkey") % 500 == 0, 1).otherwise(0).alias("rare_flag"), F.col("l_quantity").alias("qty_dup"),
        F.when(F.col("l_orderkey") % 10 == 0, F.col("l_tax")).alias("hollow"),
        F.concat(F.lit("K"), F.col("l_partkey")).alias("high_card"), "p_brand", "p_size", "s_acctbal",
        (F.col("l_extendedprice") * 1.1 + F.col("l_tax")).alias("price_scaled"))


def frame(t, verdicts):
    df = t.spark.createDataFrame([v for v in verdicts], "feature string, survived boolean, score double, reason string")
    return rounded(df, "score")


def corr_rows(cols, reason="corr"):
    return " union all ".join(
        f"select '{c}' as feature, abs(corr({c}, y)) < 0.98 as survived, round(abs(corr({c}, y)), 6) as score, "
        f"case when abs(corr({c}, y)) < 0.98 then '' else '{reason}' end as reason from w" for c in cols)


@query("fn00_leakage", f"with {FRAME} " + corr_rows(["l_quantity", "leak", "l_discount", "p_size"]) + """
union all select 'final_flag', false, null, 'name' union all select 'p_brand', true, null, ''""")
def _(t):
    return frame(t, N.stage0_leakage(wide(t), "y", ["l_quantity", "final_flag", "leak", "l_discount", "p_brand", "p_size"]))


SHARE = "select max(n) / sum(n) from (select {c}, count(*) as n from w group by 1)"


def share_rows(cols, dup):
    return " union all ".join(
        f"select '{c}' as feature, s < 0.99 and '{dup.get(c, '')}' = '' as survived, round(s, 6) as score, "
        f"case when s >= 0.99 then 'near_constant' else '{dup.get(c, '')}' end as reason from (select max(n) / sum(n) as s "
        f"from (select {c}, count(*) as n from w group by 1))" for c in cols)


@query("fn01_degenerate", f"with {FRAME} " + share_rows(["l_quantity", "rare_flag", "qty_dup", "hollow", "p_brand"],
                                                         {"qty_dup": "duplicate_of:l_quantity"}))
def _(t):
    return frame(t, N.stage1_degenerate(wide(t), ["l_quantity", "rare_flag", "qty_dup", "hollow", "p_brand"], KEY))


@query("fn02_missing", f"""with {FRAME}
select 'hollow' as feature, avg((hollow is null)::int) < 0.8 as survived, round(avg((hollow is null)::int), 6) as score,
  case when avg((hollow is null)::int) < 0.8 then '' else 'missing' end as reason from w
union all select 'p_size', true, round(avg((p_size is null)::int), 6), '' from w""")
def _(t):
    return frame(t, N.stage2_missing(wide(t), ["hollow", "p_size"]))


@query("fn03_cardinality", f"""with {FRAME}
select 'high_card' as feature, count(distinct high_card) <= 100 as survived, count(distinct high_card)::double as score,
  case when count(distinct high_card) <= 100 then '' else 'cardinality' end as reason from w
union all select 'p_brand', count(distinct p_brand) <= 100, count(distinct p_brand)::double,
  case when count(distinct p_brand) <= 100 then '' else 'cardinality' end from w
union all select 'l_tax', true, null, ''""")
def _(t):
    return frame(t, N.stage3_cardinality(wide(t), ["high_card", "p_brand", "l_tax"]))


SPREAD = "select stddev_samp(m) from (select {c}, avg({y}) as m from w group by 1)"


@query("fn04_signal", f"""with {FRAME}
select 'l_quantity' as feature, true as survived, round(abs(corr(l_quantity, y)), 6) as score, '' as reason from w
union all select 'hollow', true, round(abs(corr(hollow, y)), 6), '' from w
union all select 'p_brand', true, round(({SPREAD.format(c='p_brand', y='y')}), 6), ''""")
def _(t):
    return frame(t, N.stage4_signal(wide(t), "y", ["l_quantity", "hollow", "p_brand"]))


@query("fn04_signal_rare", f"""with {FRAME}, u as (
  select 'l_quantity' as feature, l_quantity as v, rare_flag as y from w union all select 'p_size', p_size, rare_flag from w),
c as (select feature, v, sum(y) as p, sum(1 - y) as n from u group by all),
r as (select *, sum(n) over (partition by feature order by v) - n as nb from c)
select feature, true as survived, round(2 * abs(sum(p::double * (nb + n / 2.0)) / (sum(p)::double * sum(n)) - 0.5), 6) as score,
  '' as reason from r group by feature
union all select 'p_brand', true, round(({SPREAD.format(c='p_brand', y='rare_flag')}), 6), ''""")
def _(t):
    return frame(t, N.stage4_signal(wide(t), "rare_flag", ["l_quantity", "p_size", "p_brand"]))


@query("fn05_redundancy", f"""with {FRAME}
select 'l_extendedprice' as feature, true as survived, null::double as score, '' as reason
union all select 'p_brand', true, null, '' union all select 'p_size', true, null, ''
union all select 'price_scaled', abs(corr(l_extendedprice, price_scaled)) < 0.9, round(abs(corr(l_extendedprice, price_scaled)), 6),
  'redundant_with:l_extendedprice' from w
union all select 'l_quantity', abs(corr(l_extendedprice, l_quantity)) < 0.9,
  case when abs(corr(l_extendedprice, l_quantity)) >= 0.9 then round(abs(corr(l_extendedprice, l_quantity)), 6) end,
  case when abs(corr(l_extendedprice, l_quantity)) >= 0.9 then 'redundant_with:l_extendedprice' else '' end from w""")
def _(t):
    return frame(t, N.stage5_redundancy(wide(t), ["l_extendedprice", "p_brand", "price_scaled", "p_size", "l_quantity"]))


@query("fn06_importance")
def _(t):
    return N.stage6_importance(wide(t).withColumn("_row", F.xxhash64(*KEY)), "y", ["l_quantity", "p_brand", "l_tax", "leak"],
                               micros("l_shipdate"), "_row", folds=5, trees=50)


@query("fn07_stability", f"""with {FRAME}, z as (select *, case when l_shipdate < timestamp '1998-01-01' then y + l_tax else l_tax end as fading from w),
s as (select *, ntile(3) over (order by l_shipdate, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 10000 + l_suppkey) as sl from z),
c as (select sl, abs(corr(l_quantity, y)) as q, abs(corr(fading, y)) as f from s group by sl),
b as (select sl, stddev_samp(m) as m from (select sl, p_brand, avg(y) as m from s group by all) group by sl)
select 'l_quantity' as feature, max(q) - min(q) < 0.4 as survived, round(max(q) - min(q), 6) as score,
  case when max(q) - min(q) < 0.4 then '' else 'unstable' end as reason from c
union all select 'fading', max(f) - min(f) < 0.4, round(max(f) - min(f), 6), case when max(f) - min(f) < 0.4 then '' else 'unstable' end from c
union all select 'p_brand', max(m) - min(m) < 0.4, round(max(m) - min(m), 6), case when max(m) - min(m) < 0.4 then '' else 'unstable' end from b""")
def _(t):
    early = F.col("l_shipdate") < F.to_timestamp(F.lit("1998-01-01"))
    df = wide(t).withColumn("fading", F.when(early, F.col("y") + F.col("l_tax")).otherwise(F.col("l_tax"))).withColumn(
        "_row", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey"))
    return frame(t, N.stage7_stability(df, "y", ["l_quantity", "fading", "p_brand"], "l_shipdate", "_row"))


CATALOG = """cat as (select 'f' || p_partkey as feature, (p_size % 7)::double as cost, p_partkey % 3 <> 0 as online_available, p_brand from part)"""


def catalog(t):
    return t.part.select(F.concat(F.lit("f"), F.col("p_partkey")).alias("feature"), (F.col("p_size") % 7).cast("double").alias("cost"),
                         (F.col("p_partkey") % 3 != 0).alias("online_available"), "p_brand")


@query("fn08_sign_off", f"""with {CATALOG}
select 8 as stage, feature, p_brand in ('Brand#2', 'Brand#17') as survived, null::double as score,
  case when p_brand in ('Brand#2', 'Brand#17') then '' else 'no_sign_off' end as reason from cat""")
def _(t):
    return N.stage8_sign_off(catalog(t), catalog(t).where(F.col("p_brand").isin("Brand#2", "Brand#17")))


@query("fn09_serving", f"""with {CATALOG}
select 9 as stage, feature, online_available and cost <= 4 as survived, cost as score,
  case when not online_available then 'offline' when cost > 4 then 'cost' else '' end as reason from cat""")
def _(t):
    return N.stage9_serving(catalog(t), 4.0)


@query("fn10_confirmation")
def _(t):
    df = wide(t)
    late = F.col("l_shipdate") >= F.to_timestamp(F.lit("2000-06-01"))
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/holdout-scores-{uuid.uuid4().hex}"
    return N.stage10_confirm(df.where(~late), df.where(late), "y", ["l_quantity", "p_brand", "l_tax"], "first", path, trees=50)


def _chain_sql():
    left1 = ["l_quantity", "l_extendedprice", "l_discount", "rare_flag", "qty_dup", "hollow", "high_card", "p_brand",
             "p_size", "s_acctbal", "price_scaled", "l_tax"]
    left2 = [c for c in left1 if c not in ("rare_flag", "qty_dup")]
    left3 = [c for c in left2 if c != "hollow"]
    left4 = [c for c in left3 if c != "high_card"]
    num4 = [c for c in left4 if c != "p_brand"]
    parts = ["select 0 as stage, * from (" + corr_rows([c for c in left1 if c not in ("high_card", "p_brand")] + ["leak"])
             + " union all select 'final_flag', false, null, 'name' union all select 'p_brand', true, null, '' "
               "union all select 'high_card', true, null, '')"]
    parts.append("select 1 as stage, * from (" + share_rows(left1, {"qty_dup": "duplicate_of:l_quantity"}) + ")")
    parts.append("select 2 as stage, * from (" + " union all ".join(
        f"select '{c}', avg(({c} is null)::int) < 0.8, round(avg(({c} is null)::int), 6), "
        f"case when avg(({c} is null)::int) < 0.8 then '' else 'missing' end from w" for c in left2) + ")")
    parts.append("select 3 as stage, * from (" + " union all ".join(
        f"select '{c}', count(distinct {c}) <= 100, count(distinct {c})::double, case when count(distinct {c}) <= 100 then '' "
        f"else 'cardinality' end from w" if c in ("high_card", "p_brand") else f"select '{c}', true, null::double, ''"
        for c in left3) + ")")
    parts.append("select 4 as stage, * from (" + " union all ".join(
        f"select '{c}', true, round(abs(corr({c}, y)), 6), '' from w" for c in num4)
        + f" union all select 'p_brand', true, round(({SPREAD.format(c='p_brand', y='y')}), 6), '')")
    parts.append("select 5 as stage, * from (" + " union all ".join(
        f"select '{c}', true, null::double, ''" for c in left4 if c != "price_scaled")
        + " union all select 'price_scaled', false, round(abs(corr(l_extendedprice, price_scaled)), 6), "
          "'redundant_with:l_extendedprice' from w)")
    return f"with {FRAME} " + " union all ".join(parts)


@query("fn11_chain", _chain_sql())
def _(t):
    return rounded(N.run(wide(t), "y", CANDS, KEY), "score")


@query("fn11_stage_counts", "select stage, count(*) as entered, count(*) filter (survived) as survivors from (" + _chain_sql() + ") group by stage")
def _(t):
    return N.stage_counts(N.run(wide(t), "y", CANDS, KEY))


@query("fn12_stop_rule", "with " + PRED + """
, f as (select l_linenumber as fold, -avg(abs(y - p)) as score, -avg(abs(y - p)) + avg(abs(y - p_base)) as lift from pred group by 1)
select round(max(lift), 6) as best_lift, round(stddev_samp(score) / sqrt(count(score)), 6) as se,
  max(lift) < stddev_samp(score) / sqrt(count(score)) as stop from f""")
def _(t):
    p = predictions(t.lineitem)
    a = M.neg_mae(p, "y", "p", ["l_linenumber"]).select("l_linenumber", F.col("value").alias("score"))
    b = M.neg_mae(p, "y", "p_base", ["l_linenumber"]).select("l_linenumber", F.col("value").alias("base"))
    lifts = a.join(b, "l_linenumber").withColumn("lift", F.col("score") - F.col("base"))
    return rounded(N.stop_rule(lifts, a), "best_lift", "se")
