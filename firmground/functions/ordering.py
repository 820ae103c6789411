"""Order-dependent building blocks that never gather one group, or the whole table, in a single task.

A window without a partition pulls every row into one task, and a window partitioned by a hot key pulls that
key's rows into one task. The helpers here cut an ordering into contiguous chunks. The chunk of a row is a pure
function of its value and of literal bounds, so recomputing a lost partition always gives the same chunk. The
bounds steer balance only; results never depend on them.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from firmground.functions.columns import join_by, linear_bucket, micros

CHUNK = "_chunk"


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunk_bounds(df: DataFrame, cols: list[str], chunks: int | None = None) -> list[list[float]]:
    """Approximate quantiles of numeric columns as literal chunk bounds (one driver-side list per column)."""
    chunks = chunks or parallelism(df.sparkSession)
    if chunks == 1:
        return [[] for _ in cols]
    probs = [i / chunks for i in range(1, chunks)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(cols, probs, 0.5 / chunks)
    return [sorted(set(b)) for b in found]


def with_chunk(df: DataFrame, col: str, bounds: list[float], out: str = CHUNK) -> DataFrame:
    """Add the index of the chunk holding the value: chunk i is [bounds[i-1], bounds[i])."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    tmp = "_binned"
    binned = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(tmp, F.col(col).cast("double"))
    )
    return binned.drop(tmp)


def with_order_chunk(df: DataFrame, order: list[str], chunks: int | None = None, out: str = CHUNK) -> DataFrame:
    """Add a chunk index growing with the order of one or two numeric columns.

    A first value so frequent that it fills several quantiles is cut further by the second column, so not even one
    timestamp with a third of the rows is a single chunk.
    """
    return order_chunks(df, order, chunks, out)[0]


def order_chunks(df: DataFrame, order: list[str], chunks: int | None = None, out: str = CHUNK,
                 judged_by: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """:func:`with_order_chunk`, and the first values that lie in several chunks. The bounds come from ``judged_by``,
    a frame with the same order columns and about the same shares, where that is cheaper to read."""
    chunks = chunks or parallelism(df.sparkSession)
    judged = df if judged_by is None else judged_by
    if chunks == 1:
        return df.withColumn(out, F.lit(0.0)), []
    probs = [i / chunks for i in range(1, chunks)]
    marks = judged.select(F.col(order[0]).cast("double").alias("o")).approxQuantile("o", probs, 0.5 / chunks)
    heavy = {v: n for v, n in Counter(marks).items() if n > 1} if len(order) > 1 else {}
    df = with_chunk(df, order[0], sorted(set(marks)), out)
    if not heavy:
        return df, []
    first, second = F.col(order[0]).cast("double"), F.col(order[1]).cast("double")
    most = max(heavy.values()) + 1
    part = None
    # values of about one size are cut together, so a value gets at most twice the cuts that its rows call for
    for size in sorted({n.bit_length() for n in heavy.values()}):
        alike = [v for v, n in heavy.items() if n.bit_length() == size]
        pieces = max(heavy[v] for v in alike) + 2
        wanted = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
        for r in judged.where(first.isin(alike)).groupBy(first.alias("v")).agg(
                F.percentile_approx(second, wanted, 10 * chunks).alias("cuts")).collect():
            cuts = F.array(*[F.lit(c) for c in sorted(set(r["cuts"] or []))]).cast("array<double>")
            value = F.size(F.filter(cuts, lambda c: c <= second))
            part = F.when(first == r["v"], value) if part is None else part.when(first == r["v"], value)
    part = F.lit(most) if part is None else part.otherwise(most)
    return df.withColumn(out, F.col(out) * (most + 1) + part), list(heavy)


_AGG: dict[str, Callable] = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def running(
    df: DataFrame,
    order: list[str],
    aggs: dict[str, tuple[str, str]],
    by: list[str] | None = None,
    descending: bool = False,
    inclusive: bool = True,
    bounds: list[float] | None = None,
    chunk_col: str | None = None,
) -> DataFrame:
    """Add running aggregates in the given order: ``aggs = {out: ("sum" | "min" | "max", column)}``.

    The first order columns are numeric and cut the order into chunks (see :func:`with_order_chunk`). Inside a chunk
    a plain window runs; chunk totals (at most one row per group and chunk) are scanned separately and joined back
    as the carry-in. Nulls in ``by`` form a group like any other. Pass ``bounds`` to cut by given values of ``order[0]``, or
    ``chunk_col`` when the chunk index is already a column, growing with the order inside each group.
    """
    by = by or []
    own = chunk_col is None
    if chunk_col is None:
        df = with_order_chunk(df, order[:2]) if bounds is None else with_chunk(df, order[0], bounds)
        chunk_col = CHUNK
    turn = F.desc if descending else F.asc
    edge = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*by, chunk_col).orderBy(*[turn(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, edge)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(turn(chunk_col)).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, chunk_col).agg(*[_AGG[k](c).alias(f"_t_{o}") for o, (k, c) in aggs.items()])
    carry = totals.select(
        *by, chunk_col, *[_AGG[k](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (k, _) in aggs.items()])
    local = df.select("*", *[_AGG[k](c).over(inside).alias(f"_l_{o}") for o, (k, c) in aggs.items()])
    joined = join_by(local, carry, [*by, chunk_col], "left")
    keep = [c for c in df.columns if not (own and c == CHUNK)]
    return joined.select(
        *keep, *[_merge(k, F.col(f"_l_{o}"), F.col(f"_c_{o}")).alias(o) for o, (k, _) in aggs.items()])


def as_number(df: DataFrame, col: str) -> Column:
    """A double that never falls while the column rises: for cutting an order, not for comparing values."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(col).cast("double")
    if isinstance(kind, T.StringType):  # its first six bytes
        return F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(col).cast("double")


def with_group_chunk(df: DataFrame, key: str, at: str, out: str = CHUNK) -> DataFrame:
    """Add a chunk index over the order (hash of the key, ``at``).

    A chunk holds about an even share of the rows. The rows of an ordinary key lie in one chunk; a key with more than
    such a share is cut along ``at``.
    """
    return group_chunks(df, key, at, out)[0]


def group_chunks(df: DataFrame, key: str, at: str, out: str = CHUNK,
                 judged_by: DataFrame | None = None) -> tuple[DataFrame, Column | None]:
    """:func:`with_group_chunk`, and the condition that the key of a row is cut; None where no key is.

    Chunks are ranges of the order, and only keys whose hash fills several of them are cut, so this condition is exact.
    """
    def marked(x: DataFrame) -> DataFrame:
        return x.withColumns({"_h": F.xxhash64(key).cast("double"), "_at_number": as_number(x, at)})

    chunked, heavy = order_chunks(marked(df), ["_h", "_at_number"], out=out,
                                  judged_by=None if judged_by is None else marked(judged_by))
    return chunked.drop("_h", "_at_number"), F.xxhash64(key).cast("double").isin(heavy) if heavy else None


def grouped_running(
    df: DataFrame,
    key: str,
    by: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, str]],
    descending: bool = False,
    inclusive: bool = True,
    chunk_col: str | None = None,
    cut: Column | None = None,
) -> DataFrame:
    """Running aggregates per group ``by``: the key, and columns that do not fall along ``order[0]``.

    Pass ``chunk_col`` and ``cut`` of :func:`group_chunks` where the index is a column already; then it stays. A group that
    is not cut lies in one chunk, so its plain window is the result. Of the others, only one begins before each border
    of chunks (per equal hash), so what is carried in has fewer rows than there are chunks and is broadcast.
    """
    own = chunk_col is None
    if own:
        chunk_col = "_group_chunk"
        df, cut = group_chunks(df, key, order[0], chunk_col)
    turn = F.desc if descending else F.asc
    parts = by if cut is None else [*by, chunk_col]
    inside = Window.partitionBy(*parts).orderBy(*[turn(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = df.select("*", *[_AGG[k](c).over(inside).alias(f"_l_{o}") for o, (k, c) in aggs.items()])
    keep = [c for c in df.columns if not (own and c == chunk_col)]
    if cut is None:
        return local.select(*keep, *[F.col(f"_l_{o}").alias(o) for o in aggs])
    line = Window.partitionBy(*by).orderBy(turn(chunk_col))
    carry = df.where(cut).groupBy(*by, chunk_col).agg(
        *[_AGG[k](c).alias(f"_t_{o}") for o, (k, c) in aggs.items()]
    ).select(
        *by, chunk_col, F.row_number().over(line).alias("_piece"),
        *[_AGG[k](f"_t_{o}").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{o}") for o, (k, _) in aggs.items()],
    ).where("_piece > 1").drop("_piece")
    joined = join_by(local, F.broadcast(carry), [*by, chunk_col], "left")
    return joined.select(
        *keep, *[_merge(k, F.col(f"_l_{o}"), F.col(f"_c_{o}")).alias(o) for o, (k, _) in aggs.items()])


def framed(
    df: DataFrame,
    key: str,
    order: list[str],
    compute: Callable[[DataFrame, list[str]], DataFrame],
    back: int = 1,
    ahead: int = 0,
    block: int = 500_000,
) -> DataFrame:
    """Apply window columns whose frame reaches at most ``back`` rows before and ``ahead`` rows after each row.

    ``compute(frame, partition_columns)`` adds the columns with windows partitioned by ``partition_columns``. Where no key
    holds more than a partition's share, these are the windows of the keys. Else the rows of each key are numbered,
    cut into blocks of ``block`` rows and given a halo of ``back`` / ``ahead`` neighbours, so no task holds a whole key
    with very many rows, and results equal those of the plain window.
    """
    chunked, cut = group_chunks(df, key, order[0], "_group_chunk")
    if cut is None:
        return compute(df, [key])
    block = max(block, back + ahead + 1)
    numbered = grouped_running(chunked.withColumn("_one", F.lit(1)), key, [key], order, {"_rn": ("sum", "_one")},
                               chunk_col="_group_chunk", cut=cut)
    home = linear_bucket(F.col("_rn"), block)
    pos = F.pmod(F.col("_rn"), F.lit(block))
    copies = F.array_compact(F.array(
        F.struct(home.alias("blk"), F.lit(True).alias("own")),
        F.when(pos >= block - back, F.struct((home + 1).alias("blk"), F.lit(False).alias("own"))),
        F.when(pos < ahead, F.struct((home - 1).alias("blk"), F.lit(False).alias("own"))),
    ))
    spread = numbered.withColumn("_copy", F.explode(copies)).select(
        *df.columns, F.col("_copy.blk").alias("_blk"), F.col("_copy.own").alias("_own"))
    return compute(spread, [key, "_blk"]).where("_own").drop("_own", "_blk")


def value_counts(df: DataFrame, cols: list[str], by: list[str] | None = None,
                 measures: dict[str, Column] | None = None, cuts: list[list[float]] | None = None) -> DataFrame:
    """Collapse numeric columns to ``(by…, column, value, chunk, measures…)``; the default measure ``n`` counts rows.

    Null and NaN cells are left out. The chunk of each value comes from per-column bounds (``cuts``, or
    approximate quantiles).
    """
    by = by or []
    measures = measures or {"n": F.lit(1)}
    cuts = cuts or chunk_bounds(df, cols)
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols],
                     *[m.cast("bigint").alias(f"_m_{k}") for k, m in measures.items()])
    for c, b in zip(cols, cuts):
        wide = with_chunk(wide, c, b, f"_chunk_of_{c}")
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(c) + 0.0).alias("value"), F.col(f"_chunk_of_{c}").alias(CHUNK))
        for c in cols])).alias("cell")
    return (
        wide.select(*by, *[f"_m_{k}" for k in measures], cells)
        .select(*by, *[f"_m_{k}" for k in measures], "cell.*")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "column", "value", CHUNK).agg(*[F.sum(f"_m_{k}").alias(k) for k in measures])
    )


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per (by…, column): ``n, q0, q1, …`` in the order of ``probs``.

    Equal values are collapsed on the map side, ranks come from chunked running counts, and the two order
    statistics around each position are picked by conditional aggregates. No task ever holds a whole column.
    """
    by = by or []
    counts = value_counts(df, cols, by)
    group = [*by, "column"]
    ranked = running(counts, ["value"], {"_upto": ("sum", "n")}, group, chunk_col=CHUNK)
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    placed = join_by(ranked, totals, group)
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_upto") - F.col("n") <= pos) & (pos < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*group, "total").agg(*picks)
    outs = []
    for i, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        outs.append((F.col(f"_lo{i}") + frac * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q{i}"))
    return found.select(*group, F.col("total").alias("n"), *outs)


def order_cuts(df: DataFrame, keys: list[str], ranks_of: Callable[[int], list[int]]) -> list[tuple | None]:
    """Where zero-based ranks of the order by ``keys`` (integer columns) lie; ``ranks_of`` maps the row count to ranks.

    Returned to the driver, one ``(values, left)`` per rank (None past the end): the row of that rank has the ``values``
    of the first keys, and ``left`` rows with the same values come before it. A further key is only looked at where
    the ones before leave rows undecided. A split then is a plain comparison on the scan.
    """
    n = df.count()
    ranks = ranks_of(n)
    places: dict[int, tuple[tuple, int]] = {r: ((), r) for r in ranks if 0 <= r < n}
    for depth, key in enumerate(keys):
        if not any(left for _, left in places.values()):
            break
        before = keys[:depth]

        def within(values: tuple) -> Column:
            same = F.lit(True)
            for k, v in zip(before, values):
                same = same & (F.col(k) == F.lit(v))
            return same

        wanted = F.lit(False)
        for values, _ in places.values():
            wanted = wanted | within(values)
        counts = df.where(wanted).groupBy(*before, key).agg(F.count(F.lit(1)).alias("n"))
        upto = running(counts, [key], {"upto": ("sum", "n")}, before)
        hit = F.lit(False)
        for values, left in places.values():
            hit = hit | (within(values) & (F.col("upto") - F.col("n") <= left) & (F.lit(left) < F.col("upto")))
        rows = upto.where(hit).select(*before, key, (F.col("upto") - F.col("n")).alias("start"), "upto").collect()
        for r, (values, left) in places.items():
            row = next(x for x in rows if tuple(x[k] for k in before) == values and x["start"] <= left < x["upto"])
            places[r] = ((*values, row[key]), left - row["start"])
    return [places.get(r) for r in ranks]


def at_or_after(keys: list[str], cut: tuple | None, copy: str | None = None) -> Column:
    """Whether a row lies at or after a cut of :func:`order_cuts`.

    ``copy`` numbers the rows with equal keys from 1; it is only read where a cut falls between such rows.
    """
    if cut is None:
        return F.lit(False)
    values, left = cut
    after = F.col(copy) > left if left else F.lit(True)
    for k, v in reversed(list(zip(keys, values))):
        after = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & after)
    return after
