"""Numbers for text labels, found on Spark: no list of labels ever reaches the driver.

Labels are sorted by a range partitioning, numbered within their partitions, and moved up by the number of labels before
each partition; that number is all the driver sees. The code of a label is its place within its column.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from firmground.functions.columns import exploded
from firmground.functions.ordering import parallelism
from firmground.sources.scratch import stored

PLACE = 33  # bits of a row's place within its partition, as Spark's increasing ids have them


def numbered(df: DataFrame, order: list[Column], out: str, name: str = "numbered", keep: list[str] | None = None) -> DataFrame:
    """Add 0, 1, 2, … in a global order; ``keep`` names the columns that stay, all by default. Rows that tie in all of
    ``order`` should be alike."""
    keep = df.columns if keep is None else keep
    placed = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(placed.select(*keep, F.monotonically_increasing_id().alias("_at")), name)
    part = F.shiftright("_at", PLACE)
    before, starts = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((r["part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")  # one row per partition
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE) - 1))
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(*keep, (F.col("_before") + place).alias(out))


def label_codes(df: DataFrame, cols: list[str], frequent_first: bool = False) -> DataFrame:
    """``column, label, code``: known labels of each text column as 0, 1, 2, …, by the bytes of the label or, if
    ``frequent_first``, from the most frequent one (ties by the label). A table in the shared folder, small or not."""
    cells = exploded(df, [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"))) for c in cols])
    labels = cells.groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("column"), *([F.desc("n")] if frequent_first else []), F.col("label")]
    ranked = stored(numbered(labels, order, "_rank", "labels"), "ranked-labels")
    first = ranked.groupBy("column").agg(F.min("_rank").alias("_first"))  # one row per column
    return stored(ranked.join(F.broadcast(first), "column").select("column", "label", (F.col("_rank") - F.col("_first")).alias("code")), "label-codes")


def with_codes(df: DataFrame, codes: DataFrame, cols: dict[str, str], unseen: bool = True) -> DataFrame:
    """Add the code of each text column as a double, ``cols = {column: output}``.

    A null stays null; a label without a code gets the next number if ``unseen``, else null. Whether a column's codes are
    broadcast or joined by a shuffle is decided by the size of the stored table.
    """
    sizes = {r["column"]: float(r["n"]) for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per column
    for c, out in cols.items():
        mine = codes.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").cast("double").alias("_code"))
        df = df.join(mine, F.col(c).cast("string") == F.col("_label"), "left")
        other = F.when(F.col(c).isNotNull(), F.lit(sizes.get(c, 0.0))) if unseen else F.lit(None).cast("double")
        df = df.withColumn(out, F.coalesce("_code", other)).drop("_label", "_code")
    return df
