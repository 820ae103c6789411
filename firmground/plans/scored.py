"""The prediction table shared by the metric, calibration, decision and monitoring queries, in both dialects."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

PRED = """pred as (
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as segment, l_linestatus as channel,
       l_shipdate as ts, l_quantity as qty, l_extendedprice as price,
       case when l_returnflag = 'R' then 1 else 0 end as y,
       round(0.05 + 0.6 * (((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000) / 1000.0::double)
             + case when l_returnflag = 'R' and l_linenumber % 2 = 0 then 0.3::double else 0::double end, 4) as p,
       round(0.1::double + 0.8::double * (((l_suppkey * 11 + l_linenumber * 3) % 500) / 500.0::double), 4) as p_base
from lineitem)"""


def predictions(lineitem: DataFrame) -> DataFrame:
    unit = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7) % 1000) / 1000.0
    base = ((F.col("l_suppkey") * 11 + F.col("l_linenumber") * 3) % 500) / 500.0
    lift = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0), 0.3).otherwise(0.0)
    return lineitem.select(
        *KEY, F.col("l_returnflag").alias("segment"), F.col("l_linestatus").alias("channel"),
        F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.round(F.lit(0.05) + F.lit(0.6) * unit + lift, 4).alias("p"),
        F.round(F.lit(0.1) + F.lit(0.8) * base, 4).alias("p_base"),
    )
