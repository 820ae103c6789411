"""Small column helpers: nulls, time in microseconds, name and type tests, hash buckets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

DAY_US = 86_400_000_000


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def is_null(df: DataFrame, name: str) -> Column:
    """NULL and NaN are one concept."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN turned into NULL."""
    return F.when(~is_null(df, name), F.col(name).cast("double"))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch for a timestamp, date or zone-less timestamp column."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast("timestamp"))


def whole_days(later: Column, earlier: Column) -> Column:
    """floor((later - earlier) / 1 day) of two timestamps."""
    delta = micros(later) - micros(earlier)
    return F.floor(delta / F.lit(float(DAY_US))).cast("int")


def md5_bucket(key: Column | str, buckets: int, seed: str = "") -> Column:
    """Stable bucket in [0, buckets) from the first 32 bits of md5(seed || key)."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(seed), key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def linear_bucket(value: Column, width: int) -> Column:
    """Index of the left-closed block of the given integer width, exact for negative values too."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def wide_aggs(df: DataFrame, exprs: list[Column], size: int = 100, by: list[str] | None = None) -> list[DataFrame]:
    """Split a long list of aggregates so that no single aggregation exceeds what one generated method can hold."""
    by = by or []
    return [df.groupBy(*by).agg(*exprs[i:i + size]) for i in range(0, len(exprs), size)]


def collect_stats(df: DataFrame, exprs: list[Column], size: int = 100) -> dict:
    """Collect one row of aggregates (one value per expression) to the driver."""
    out: dict = {}
    for part in wide_aggs(df, exprs, size):
        out.update(part.first().asDict())
    return out


def attach(df: DataFrame, one_row: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add the columns of a one-row frame to every row, as a scalar subquery (no join)."""
    names = names or one_row.columns
    value = one_row.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("_one_row", value).select(*df.columns, *[F.col(f"_one_row.{n}").alias(n) for n in names])


def join_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where two nulls are equal too."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    named = right.withColumnsRenamed({k: f"_by_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return left.join(named, same, how).drop(*[f"_by_{k}" for k in keys])


def exploded(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn struct columns of each row into rows; NULL structs vanish."""
    return df.select(F.explode(F.array_compact(F.array(*structs))).alias("_row")).select("_row.*")


def long_counts(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts of every value of every column as text: ``by…, column, value, n`` (nulls and NaN are one value, and so are 0.0 and -0.0)."""
    by = by or []

    def plain(c: str) -> Column:
        return F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c)

    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(~is_null(df, c), plain(c).cast("string")).alias("value"))
        for c in cols])).alias("cell")
    return df.select(*by, cells).select(*by, "cell.*").groupBy(*by, "column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pairwise-complete correlation aggregate; NULL without spread (the built-in one fails on a constant column)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("double"), b.cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))
