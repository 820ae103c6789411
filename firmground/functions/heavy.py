"""Most frequent values and distinct counts of many columns, without turning numbers into text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from firmground.functions.columns import collect_stats, is_null, union_all

WHOLE = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SKETCHED = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Entries of a frequent-items summary, and the share above which it is sure to report a value (twice its error).
TRACKED, SURE = 256, 2 * 3.5 / 512
CELL = ["whole", "real", "text"]


def cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per cell, ``column, whole, real, text``: whole numbers, dates and times in the first, fractions in the second,
    everything else as text in the third; all null for null and NaN. Equal cells are equal values (0.0 and -0.0 too)."""
    def cell(c: str) -> Column:
        kind, value = df.schema[c].dataType, F.when(~is_null(df, c), F.col(c))
        whole = real = text = None
        if isinstance(kind, WHOLE):
            whole = value.cast("bigint")
        elif isinstance(kind, T.DateType):
            whole = F.unix_date(value).cast("bigint")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            whole = F.unix_micros(value.cast("timestamp"))
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            real = value.cast("double") + F.lit(0.0)
        else:
            text = value.cast("string")
        null = F.lit(None)
        return F.struct(F.lit(c).alias("column"), *[(null if v is None else v).cast(k).alias(n) for v, k, n in zip(
            (whole, real, text), ("bigint", "double", "string"), CELL)])

    return df.select(F.explode(F.array(*[cell(c) for c in cols])).alias("c")).select("c.*")


def known() -> Column:
    return F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))


def cell_counts(df: DataFrame, cols: list[str], block: int = 50) -> DataFrame:
    """``column, rows, top, distinct, nulls`` by counting every value: ``top`` is the count of the most frequent one, null being
    a value, ``distinct`` the number of known values.

    A column is counted by its own values, in its own type: cells of all columns in one shuffle would be wider and more. Many
    columns go through such a shuffle, as a plan with a branch for each would not be small.
    """
    if len(cols) > block:
        counts = cells(df, cols).groupBy("column", *CELL).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("column").agg(
            F.sum("n").alias("rows"), F.max("n").alias("top"), F.count_if(known()).alias("distinct"),
            F.coalesce(F.sum(F.when(~known(), F.col("n"))), F.lit(0)).alias("nulls"))

    def one(c: str) -> DataFrame:
        value = F.when(~is_null(df, c), F.col(c))
        if not isinstance(df.schema[c].dataType, SKETCHED):
            value = value.cast("string")
        counts = df.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(
            F.sum("n").alias("rows"), F.max("n").alias("top"), F.count("v").alias("distinct"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls")).where("rows > 0").select(
                F.lit(c).alias("column"), "rows", "top", "distinct", "nulls")

    return union_all([one(c) for c in cols])


def heavy_counts(df: DataFrame, cols: list[str], least: float = 0.5, block: int = 50) -> dict[str, dict]:
    """``rows, nulls, top, proved`` of each column from two passes without a shuffle of cells.

    A mergeable summary of frequent items proposes values, the second pass counts them exactly. ``top`` is the count of the
    most frequent value, null being one, wherever ``proved``: no value outside of the proposed ones can be more frequent. A
    value with a share of ``least`` or more always is proved.
    """
    picks = max(3, int(1 / least) + 1)
    if least <= SURE:
        raise ValueError(f"shares up to {SURE:.4f} are not sure to be found")
    out: dict[str, dict] = {}
    for at in range(0, len(cols), block):
        some = cols[at:at + block]
        able = [c for c in some if isinstance(df.schema[c].dataType, SKETCHED)]
        clean = df.select(*[F.when(~is_null(df, c), F.col(c)).alias(f"c{i}") for i, c in enumerate(some)])
        facts = [F.count(F.lit(1)).alias("#")] + [F.count_if(F.col(f"c{i}").isNull()).alias(f"n{i}") for i in range(len(some))]
        facts += [F.expr(f"approx_top_k(c{some.index(c)}, {picks + 1}, {TRACKED})").alias(f"t{some.index(c)}") for c in able]
        first = clean.agg(*facts).first()
        told = {i: first[f"t{i}"] or [] for i in (some.index(c) for c in able)}
        tried = {i: [x["item"] for x in found if x["item"] is not None] for i, found in told.items()}
        exact = [F.count_if(F.col(f"c{i}") == F.lit(v).cast(clean.schema[f"c{i}"].dataType)).alias(f"e{i}_{k}") for i, vs in tried.items() for k, v in enumerate(vs)]
        seen = collect_stats(clean, exact) if exact else {}
        for i, c in enumerate(some):
            rows, nulls = first["#"], first[f"n{i}"]
            top = max([nulls, *(seen[f"e{i}_{k}"] for k in range(len(tried.get(i, []))))])
            listed = told.get(i)
            # a value that is not listed counts at most the last estimate of a full list, and less than what is sure to be listed
            rest = None if listed is None else max(SURE * rows, listed[-1]["count"] if len(listed) > picks else 0)
            out[c] = {"rows": rows, "nulls": nulls, "top": top, "proved": rest is not None and top >= rest}
    return out


def top_counts(df: DataFrame, cols: list[str], least: float = 0.5) -> dict[str, tuple[int, int]]:
    """``{column: (rows, count of the most frequent value)}``, exact for every column: what the summaries do not prove is counted."""
    found = heavy_counts(df, cols, least)
    open_ = [c for c in cols if not found[c]["proved"]]
    counted = {r["column"]: r["top"] for r in cell_counts(df, open_).collect()} if open_ else {}
    return {c: (x["rows"], counted.get(c, x["top"])) for c, x in found.items()}


def repeated(df: DataFrame, cols: list[str], slices: int | None = None) -> set[str]:
    """Columns in which some value, null being one, occurs twice; with ``slices``, among the values of one hash slice only."""
    some = cells(df, cols)
    if slices:
        some = some.where(F.pmod(F.xxhash64(*CELL), F.lit(slices)) == 0)
    counts = some.groupBy("column", *CELL).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {r["column"] for r in counts.select("column").distinct().collect()}
