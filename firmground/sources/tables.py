"""Scans and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan(spark: SparkSession, path: str, cols: list[str] | None = None, limit: int | None = None,
         fmt: str | None = None, schema=None) -> DataFrame:
    """Read a table (parquet, orc, json or csv by suffix); the whole table unless a limit is asked for."""
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith(f)), "parquet")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.load(path)
    if cols:
        df = df.select(*cols)
    return df.limit(limit) if limit else df


def parse_ts(df: DataFrame, col: str, out: str | None = None, fmt: str | None = None) -> DataFrame:
    """Parse text to a timestamp; text that is no timestamp becomes NULL."""
    args = [F.col(col)] + ([F.lit(fmt)] if fmt else [])
    return df.withColumn(out or col, F.try_to_timestamp(*args))


def parse_report(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """``n, n_null, n_bad``: bad values are those which were not null before parsing and are after."""
    parsed = parse_ts(df.select(col), col, "_ts", fmt)
    return parsed.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(col).isNull()).alias("n_null"),
        F.count_if(F.col(col).isNotNull() & F.col("_ts").isNull()).alias("n_bad"),
    )


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
          mode: str = "overwrite") -> str:
    """Write a result as a folder of parquet, orc, json or csv files."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
