"""Univariate signal against a target, and the column triage table built on it."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from firmground.functions.columns import as_double, collect_stats, is_null, is_numeric, long_counts, pearson, union_all
from firmground.functions.coding import label_codes, with_codes
from firmground.functions.heavy import cell_counts
from firmground.functions.ordering import quantiles
from firmground.operators.audit import duplicate_columns
from firmground.operators.metrics import column_auc

# Name parts that explain a column on their own.
READABLE = (
    "age", "amount", "balance", "count", "date", "duration", "fee", "income", "length", "month", "number", "payment",
    "percent", "price", "rate", "ratio", "revenue", "salary", "score", "sum", "time", "total", "value", "volume",
    "weight", "year",
)


#: Fixed value: a target with more different values is continuous.
MAX_CLASSES = 20


def class_values(df: DataFrame, target: str) -> list[float]:
    """Up to ``MAX_CLASSES + 1`` different values of a numeric column, in order."""
    value = F.col(target).cast("double") + 0.0
    return sorted(r[0] for r in df.where(~is_null(df, target)).select(value).distinct().limit(MAX_CLASSES + 1).collect())


def coded_target(df: DataFrame, target: str, out: str = "_y") -> DataFrame:
    """Rows with a known target and its numeric code.

    Text is numbered in alphabetical order. A numeric target with at most ``MAX_CLASSES`` different values holds classes,
    which are numbered in numeric order, so that the distance between two codes means nothing; others stay as they are.
    """
    known = df.where(~is_null(df, target))
    if is_numeric(df, target):
        value = F.col(target).cast("double") + 0.0
        few = class_values(known, target)
        if len(few) > MAX_CLASSES:
            return known.withColumn(out, value)
        codes = F.array_position(F.array(*[F.lit(v) for v in few]).cast("array<double>"), value) - 1
        return known.withColumn(out, codes.cast("double"))
    return with_codes(known, label_codes(known, [target]), {target: out})


def filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric columns as doubles with nulls replaced by the exact median."""
    marks = {r["column"]: r["q0"] for r in quantiles(df, cols, [0.5]).collect()}
    return df.withColumns({c: F.coalesce(as_double(df, c), F.lit(marks.get(c)).cast("double")) for c in cols})


def numeric_signal(df: DataFrame, y: str, cols: list[str]) -> DataFrame:
    """``column, score``: |correlation| of the median-filled column with the target; constant columns are left out."""
    ready = filled(df, cols)
    parts = []
    for i in range(0, len(cols), 100):
        block = cols[i:i + 100]
        row = ready.agg(*[F.abs(pearson(c, y)).alias(c) for c in block], *[
            (F.min(c) < F.max(c)).alias(f"_v_{c}") for c in block])
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0.0)).alias("score"),
                                   F.col(f"_v_{c}").alias("v")) for c in block])
        parts.append(row.select(F.explode(cells).alias("r")).select("r.*").where("v").drop("v"))
    return union_all(parts)


def auc_signal(df: DataFrame, y: str, cols: list[str]) -> DataFrame:
    """``column, score`` = 2 |AUC - 0.5| of the median-filled column; NULL when a class is missing."""
    return column_auc(filled(df, cols), y, cols).select("column", (2 * F.abs(F.col("auc") - 0.5)).alias("score"))


def mutual_information(df: DataFrame, y: str, cols: list[str]) -> DataFrame:
    """``column, score, normalized``: mutual information in nats of each categorical with a discrete target."""
    text = df.select(F.col(y).alias("_y"), *[F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(c)
                                              for c in cols]).where("_y is not null")
    joint = long_counts(text, cols, ["_y"])
    px = joint.groupBy("column", "value").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("column", "_y").agg(F.sum("n").alias("ny"))
    total = py.groupBy("column").agg(F.sum("ny").alias("all"), (F.log(F.sum("ny")) - F.sum(
        F.col("ny") * F.log("ny")) / F.sum("ny")).alias("hy"))
    entropy_x = px.join(total, "column").groupBy("column").agg(
        F.sum(-F.col("nx") / F.col("all") * F.log(F.col("nx") / F.col("all"))).alias("hx"))
    full = joint.join(px, ["column", "value"]).join(py, ["column", "_y"]).join(total, "column")
    p = F.col("n") / F.col("all")
    nats = p * F.log(F.col("n") * F.col("all").cast("double") / (F.col("nx").cast("double") * F.col("ny")))
    return full.groupBy("column", "hy").agg(F.sum(nats).alias("score")).join(entropy_x, "column").select(
        "column", "score", F.try_divide("score", F.sqrt(F.col("hx") * F.col("hy"))).alias("normalized"))


def signal(df: DataFrame, target: str, leak: float = 0.98, top: int = 15) -> DataFrame:
    """Ranked signal of every column: ``column, kind, method, score, leak_suspect``.

    Numeric columns score |correlation|, or the univariate AUC when the target is binary with under 5% positives;
    categorical columns score mutual information with the class, or with the exact decile of a continuous target.
    """
    coded = coded_target(df, target)
    stats = collect_stats(coded, [
        F.avg("_y").alias("rate"), F.size(F.collect_set(F.when(F.col("_y").isin(0.0, 1.0), F.col("_y")))).alias("k01"),
        F.max((~F.col("_y").isin(0.0, 1.0)).cast("int")).alias("other")])
    classes = not is_numeric(df, target) or len(class_values(df, target)) <= MAX_CLASSES
    rare = classes and stats["k01"] == 2 and not stats["other"] and stats["rate"] < 0.05
    feats = [f for f in df.schema.fields if f.name != target]
    num = [f.name for f in feats if is_numeric(df, f.name)]
    cat = [f.name for f in feats if isinstance(f.dataType, T.StringType)]
    parts = []
    if num:
        scored = auc_signal(coded, "_y", num) if rare else numeric_signal(coded, "_y", num)
        method = "auc" if rare else "corr"
        parts.append(scored.select("column", F.lit("numeric").alias("kind"), F.lit(method).alias("method"), "score"))
    if cat:
        of, method = (coded, "mi") if classes else (with_deciles(coded, "_y"), "mi_decile")
        parts.append(mutual_information(of, "_y", cat).select(
            "column", F.lit("categorical").alias("kind"), F.lit(method).alias("method"), "score"))
    ranked = union_all(parts).withColumn("leak_suspect", (F.col("kind") == "numeric") & (F.col("score") >= leak))
    return ranked.orderBy(F.desc("score"), "column").limit(top)


def with_deciles(df: DataFrame, y: str) -> DataFrame:
    """The column replaced by the number of exact decile marks below its value, 0 to 9."""
    row = quantiles(df, [y], [i / 10 for i in range(1, 10)]).first()
    marks = F.array(*[F.lit(row[f"q{i}"]) for i in range(9)])
    return df.withColumn(y, F.size(F.filter(marks, lambda m: m < F.col(y))).cast("double"))


# Stems of generic names, and the length up to which a name tells nothing.
GENERIC, SHORT = ("col", "var", "x"), 3


def opaque_name(name: str) -> bool:
    """A name that tells nothing: very short, a generic stem, or without any readable part."""
    low = name.lower()
    return len(low) <= SHORT or low.startswith(GENERIC) or not any(p in low for p in READABLE)


def triage(df: DataFrame, target: str, key: list[str], near: float = 0.99, high_null: float = 0.95,
           source: str = "main") -> DataFrame:
    """One row per column: type, null rate, cardinality, flags, signal and the suggested bucket.

    Statistics of all columns come from a few jobs over the full table; only the per-column results meet the driver.
    """
    cols = [c for c in df.columns if c != target and c not in key]
    y_num = is_numeric(df, target)
    stats = {r["column"]: r for r in cell_counts(df, cols).collect()}
    dup = dict(duplicate_columns(df, key, cols))
    num = [c for c in cols if is_numeric(df, c)]
    scores: dict = {}
    if y_num and num:
        kinds = df.where(~is_null(df, target)).select(target).distinct().limit(3).count()
        open_cols = [c for c in num if stats[c]["nulls"] < high_null * stats[c]["rows"]]
        if kinds == 2:
            low, high = df.agg(F.min(target).cast("double"), F.max(target).cast("double")).first()
            binary = df.withColumn("_y", (F.col(target).cast("double") == high).cast("int"))
            if open_cols:
                scores.update({r["column"]: r["score"] for r in auc_signal(binary, "_y", open_cols).collect()})
            rest = [c for c in num if c not in open_cols]
        else:
            rest = num
        if rest:
            scores.update(collect_stats(df, [F.abs(pearson(as_double(df, c), as_double(df, target))).alias(c)
                                             for c in rest]))
    table = []
    for c in cols:
        s = stats[c]
        table.append((c, source, df.schema[c].dataType.simpleString(), round(s["nulls"] / s["rows"], 4),
                      s["distinct"], s["top"] >= near * s["rows"], dup.get(c, ""), round(scores.get(c) or 0.0, 4)))
    line = sorted(r[7] for r in table)
    at = 0.9 * (len(line) - 1)
    low = int(at)
    cut = line[low] + (at - low) * (line[min(low + 1, len(line) - 1)] - line[low])
    out = []
    for r in table:
        if r[5] or r[3] >= high_null or r[6]:
            bucket = "DROP-CANDIDATE"
        elif cut > 0 and r[7] >= cut:
            bucket = "HIGH-SIGNAL"
        elif r[7] > 0.01 and opaque_name(r[0]):
            bucket = "NEEDS-DOMAIN-INPUT"
        else:
            bucket = "LOW-PRIORITY"
        out.append((*r, bucket))
    return df.sparkSession.createDataFrame(out, (
        "column string, source string, dtype string, null_rate double, cardinality bigint, is_constant boolean, "
        "is_duplicate_of string, univariate_signal double, triage_bucket string"))


def triage_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("triage_bucket").agg(F.count(F.lit(1)).alias("n"))
