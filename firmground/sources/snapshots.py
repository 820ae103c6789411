"""Snapshot profiles of tables and the drift between two of them."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Names read as a time column, and the age after which a snapshot is stale.
TIME_NAME = r"date|time|_at$"
STALE_DAYS = 30


def time_column(df: DataFrame) -> str | None:
    """First column with a time-like name whose type is a time, or text that parses as one somewhere."""
    for field in df.schema.fields:
        if not re.search(TIME_NAME, field.name, re.I):
            continue
        if isinstance(field.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            return field.name
        if isinstance(field.dataType, T.StringType):
            good = df.where(F.try_to_timestamp(F.col(field.name)).isNotNull()).select(F.lit(1)).limit(1)
            if good.count():
                return field.name
    return None


def content_hash(df: DataFrame) -> Column:
    """Order-free hash over every row; the sum beside the xor tells repeated rows apart."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    mixed = F.pmod(row, F.lit(2147483647)).cast("decimal(18,0)")
    return F.concat_ws(":", F.hex(F.bit_xor(row)), F.sum(mixed).cast("string"))


def snapshot(df: DataFrame, name: str, as_of: str | None = None) -> DataFrame:
    """One row ``name, row_count, col_count, columns, hash, time_col, min_date, max_date, taken_on``."""
    tcol = time_column(df)
    day = None
    if tcol:
        src = F.col(tcol)
        day = F.to_date(F.try_to_timestamp(src) if isinstance(df.schema[tcol].dataType, T.StringType) else src)
    none = F.lit(None).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        content_hash(df).alias("hash"),
        (F.min(day) if tcol else F.first(none)).alias("min_date"),
        (F.max(day) if tcol else F.first(none)).alias("max_date"),
    ).select(
        F.lit(name).alias("name"), "row_count", F.lit(len(df.columns)).alias("col_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "hash",
        F.lit(tcol).cast("string").alias("time_col"), "min_date", "max_date",
        (F.to_date(F.lit(as_of)) if as_of else F.current_date()).alias("taken_on"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, tol: float = 0.05, today: str | None = None) -> DataFrame:
    """Drift findings ``name, type, detail, severity`` between registered and current snapshots.

    A source without a current snapshot is an error and nothing else is said about it; an unchanged hash silences
    the other checks. A row-count change over the tolerance warns, and is an error from twice the tolerance on.
    """
    o = old.select("name", F.col("row_count").alias("o_rows"), F.col("hash").alias("o_hash"),
                   F.col("max_date").alias("o_max"), "taken_on")
    n = new.select("name", F.col("row_count").alias("n_rows"), F.col("hash").alias("n_hash"),
                   F.col("max_date").alias("n_max"))
    both = o.join(n, "name", "full_outer")
    now = F.to_date(F.lit(today)) if today else F.current_date()
    change = F.try_divide(F.abs(F.col("n_rows") - F.col("o_rows")), F.col("o_rows"))
    missing = F.col("n_rows").isNull()
    drifted = ~missing & ~F.col("n_hash").eqNullSafe(F.col("o_hash"))

    def finding(cond: Column, kind: str, detail: Column, severity: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("type"), detail.alias("detail"), severity.alias("severity")))

    known = F.col("o_rows").isNotNull()
    arrow = F.lit(" -> ")
    found = F.array_compact(F.array(
        finding(missing, "missing", F.lit("no current snapshot"), F.lit("error")),
        finding(~known, "unregistered", F.lit("no earlier snapshot"), F.lit("info")),
        finding(known & drifted & (change > tol), "rowcount_drift",
                F.concat(F.col("o_rows").cast("string"), arrow, F.col("n_rows").cast("string")),
                F.when(change < 2 * tol, "warning").otherwise("error")),
        finding(known & drifted & F.col("o_max").isNotNull() & F.col("n_max").isNotNull()
                & (F.col("o_max") != F.col("n_max")), "time_range_change",
                F.concat(F.col("o_max").cast("string"), arrow, F.col("n_max").cast("string")), F.lit("info")),
        finding(known & drifted, "content_changed", F.lit("content hash differs"), F.lit("info")),
        finding(known & (F.datediff(now, "taken_on") > STALE_DAYS), "stale",
                F.concat(F.lit("taken on "), F.col("taken_on").cast("string")), F.lit("warning")),
    ))
    return both.select("name", F.explode(found).alias("f")).select("name", "f.*")
