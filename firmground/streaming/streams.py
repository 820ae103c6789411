"""Streaming forms of the monitoring checks; each gives what its batch form gives once a window has closed."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, folder: str, pattern: str, schema, ts: str, per_trigger: int | None = None) -> DataFrame:
    """File stream over matching files of a folder, the event time as a zoned timestamp."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def daily_load(sdf: DataFrame, ts: str, late: str, flagged: Column, acted: Column) -> DataFrame:
    """``day, queue, action_rate`` per day, final once the watermark has passed the day."""
    win = sdf.withWatermark(ts, late).where(flagged).groupBy(F.window(ts, "1 day").alias("w"))
    return win.agg(F.count(F.lit(1)).alias("queue"), F.avg(acted.cast("int")).alias("action_rate")).select(
        F.to_date("w.start").alias("day"), "queue", "action_rate")


def deduplicate(sdf: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """First row of each key; repeats arriving within the stated time are dropped, state is bounded by it."""
    return sdf.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def quarantine(sdf: DataFrame, rule: Column, good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Split each micro-batch by a contract rule into a good and a bad table.

    Each batch writes a folder of its own, overwritten on a retry, so a replayed batch is not counted twice.
    """
    ok = F.coalesce(rule, F.lit(False))

    def split(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_ok", ok).persist()
        marked.where("_ok").drop("_ok").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        marked.where("not _ok").drop("_ok").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        marked.unpersist()

    return sdf.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def freshness(sdf: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """``window_end, n_rows, newest, lag_seconds``: how far behind the end of each window its newest row is."""
    win = sdf.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("newest"))
    return win.select(F.col("w.end").alias("window_end"), "n_rows", "newest", (
        (F.unix_micros("w.end") - F.unix_micros("newest")) / F.lit(1e6)).alias("lag_seconds"))


def sessions(df: DataFrame, entity: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """``entity, start, end, n``: runs of events closer than the gap; give ``late`` on a stream."""
    src = df.withWatermark(ts, late) if late else df
    return src.groupBy(entity, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
        entity, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_to_table(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available now into a parquet table and read it back."""
    q = sdf.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)


def run_sessions(sdf: DataFrame, entity: str, ts: str, gap: str, late: str, path: str, checkpoint: str) -> DataFrame:
    """Run :func:`sessions` over everything available now into a table and read it back; ``gap`` and ``late`` are of fixed length.

    Each micro-batch is a plain job over its rows and the sessions still open, so that sessions which begin and close within
    a batch are no state. Open ones go to the next batch as rows of the table; the newest event's session is always among
    them, so the watermark follows from them. Each batch writes a folder of its own, overwritten on a retry.
    """
    spark = sdf.sparkSession
    rows = sdf.where(F.col(ts).isNotNull()).select(entity, F.col(ts).cast("timestamp").alias("start"))
    columns = [f"`{entity}` {rows.schema[entity].dataType.simpleString()}", "start timestamp", "end timestamp", "n long"]
    schema = ", ".join([*columns, "open string"])

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        held = session.read.schema(schema).parquet(f"{path}/batch={number - 1}").where("open = 'true'").drop("open")
        events = batch.select(entity, "start", F.expr(f"start + interval {gap}").alias("end"), F.lit(1).cast("long").alias("n"))
        passed = lambda frame: frame.agg(F.unix_micros(F.expr(f"max(end) - interval {gap} - interval {late}"))).first()[0]
        before, now = passed(held), passed(events)
        if before is not None:
            events = events.where(F.unix_micros("end") > before)
        mark = max((m for m in (before, now) if m is not None), default=0)
        w = Window.partitionBy(entity).orderBy("start", "end")
        apart = F.coalesce(F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        numbered = held.unionByName(events).withColumn("_new", apart.cast("int")).withColumn(
            "_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        found = numbered.groupBy(entity, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_s")
        found.withColumn("open", (F.unix_micros("end") > mark).cast("string")).write.mode("overwrite").partitionBy("open").parquet(
            f"{path}/batch={number}")

    # before the first batch nothing is open
    spark.createDataFrame([], ", ".join(columns)).write.mode("ignore").parquet(f"{path}/batch=-1/open=true")
    run_each(rows, step, checkpoint)
    return spark.read.schema(schema).parquet(path).where("open = 'false'").select(entity, "start", "end", "n")


def run_each(sdf: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over everything available now through a batch function."""
    sdf.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_restarted(arrivals: DataFrame, slice_: str, parts: int, make: Callable[[DataFrame], DataFrame], ts: str, folder: str,
                  run: Callable[[DataFrame, str, str], DataFrame] = run_to_table) -> DataFrame:
    """Replay a table as it arrived: rows of slice 0, 1, … become new files of one folder, and after each the stream is
    started anew from its checkpoint, so that state, watermark and the list of read files are carried over restarts.

    ``make`` turns the source stream into the result, which ``run`` appends to a table below ``folder`` and reads back. Rows of a
    slice are one micro-batch however many files it has; what is late is decided by the slices before.
    """
    spark, source = arrivals.sparkSession, f"{folder}/source"
    out = None
    for k in range(parts):
        arrivals.where(F.col(slice_) == k).drop(slice_).write.mode("append").parquet(source)
        stream = read_files(spark, source, "*.parquet", arrivals.drop(slice_).schema, ts)
        out = run(make(stream), f"{folder}/table", f"{folder}/state")
    return out
