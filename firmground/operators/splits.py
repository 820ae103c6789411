"""Train / test / fold assignment. Cuts are found once as (time, key) values; assigning a row is then a comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from firmground.functions.columns import collect_stats, is_null, is_numeric, md5_bucket, micros
from firmground.functions.ordering import at_or_after, order_cuts, running

# Fixed value: below this positive rate, average precision replaces ROC AUC.
RARE = 0.02


KEYS = ["_t", "_k", "_r"]


def _cut_split(df: DataFrame, order: Column, key: str, ranks_of, labels: list[str], out: str) -> DataFrame:
    """Cuts the order by (order, key, whole row). A key that is no integer is ordered by its hash, rows by theirs; of rows
    alike in every column it does not matter which lies before a cut, only how many."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    work = df.withColumns({"_t": order.cast("bigint"), "_k": F.col(key).cast("bigint") if whole else F.xxhash64(key),
                           "_r": F.xxhash64(*df.columns)})
    cuts = order_cuts(work.select(*KEYS), KEYS, ranks_of)
    split = [c for c in cuts if c and c[1]]
    if split:
        same = F.lit(False)
        for values, _ in split:
            same = same | ((F.col("_t") == values[0]) & (F.col("_k") == values[1]) & (F.col("_r") == values[2]))
        same = F.coalesce(same, F.lit(False))
        alike = work.where(same).withColumns({"_id": F.monotonically_increasing_id(), "_one": F.lit(1)})
        numbered = running(alike, ["_id"], {"_copy": ("sum", "_one")}, KEYS).drop("_id", "_one")
        work = work.where(~same).withColumn("_copy", F.lit(0).cast("bigint")).unionByName(numbered)
    side = F.lit(labels[0])
    for cut, label in zip(cuts, labels[1:]):
        side = F.when(at_or_after(KEYS, cut, "_copy"), F.lit(label)).otherwise(side)
    return work.withColumn(out, side).drop(*KEYS, "_copy")


def temporal_split(df: DataFrame, ts: str, key: str, frac: float = 0.2) -> DataFrame:
    """``split``: the oldest int(n (1 - frac)) rows train, the rest test; equal times ordered by key,
    then by a hash of the row."""
    return _cut_split(df, micros(ts), key, lambda n: [int(n * (1 - frac))], ["train", "test"], "split")


def random_split(df: DataFrame, key: str, frac: float = 0.2, seed: int = 0) -> DataFrame:
    """``split`` over an order given by a hash of key and seed: the same rows whatever the partitioning."""
    return _cut_split(df, md5_bucket(key, 2**31 - 1, f"{seed}:"), key, lambda n: [int(n * (1 - frac))],
                      ["train", "test"], "split")


def entity_split(df: DataFrame, entity: str, frac: float = 0.2, seed: int = 0) -> DataFrame:
    """``split`` by a hash of the entity, so that all rows of an entity fall on one side."""
    return df.withColumn("split", F.when(md5_bucket(entity, 10000, f"{seed}:") < int(frac * 10000), "test").otherwise(
        "train"))


def temporal_entity_split(df: DataFrame, ts: str, key: str, entity: str, frac: float = 0.2) -> DataFrame:
    """``split``: later rows test only if their entity is absent from train; the other later rows are ``dropped``."""
    cut = temporal_split(df, ts, key, frac)
    seen = cut.where("split = 'train'").select(F.col(entity).alias("_e")).distinct().withColumn("_seen", F.lit(True))
    late = cut.where("split = 'test'")
    marked = late.join(seen, late[entity] == seen["_e"], "left").withColumn(
        "split", F.when(F.col("_seen"), "dropped").otherwise("test")).select(*cut.columns)
    return cut.where("split = 'train'").unionByName(marked)


def three_way_split(df: DataFrame, ts: str, key: str, frac: float = 0.2, calibration: float = 0.15) -> DataFrame:
    """``split``: train, then calibration (the last share of the train side by time), then test."""
    def ranks(n: int) -> list[int]:
        train = int(n * (1 - frac))
        return [int(train * (1 - calibration)), train]

    return _cut_split(df, micros(ts), key, ranks, ["train", "calibration", "test"], "split")


def kfold(df: DataFrame, order: Column, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Contiguous folds 1…k over the order; the first n mod k folds hold one row more."""
    def ranks(n: int) -> list[int]:
        size, extra = divmod(n, k)
        return [i * size + min(i, extra) for i in range(1, k)]

    folds = _cut_split(df, order, key, ranks, [str(i) for i in range(1, k + 1)], out)
    return folds.withColumn(out, F.col(out).cast("int"))


def holdout(df: DataFrame, ts: str, key: str, frac: float = 0.15) -> DataFrame:
    """``split``: the last share by time is the confirmation holdout."""
    return temporal_split(df, ts, key, frac).withColumn(
        "split", F.when(F.col("split") == "test", "holdout").otherwise("build"))


def walk_forward(periods: DataFrame, period: str, train: int, test: int, expanding: bool = True) -> DataFrame:
    """``fold, period, role`` from a calendar of periods (one row each): train windows followed by their test window."""
    days = numbered(periods, period)
    i = F.col("_i")
    last = F.floor((F.col("_n") - train) / F.lit(test)).cast("int")
    behind = F.floor((i - train) / F.lit(test)).cast("int")  # complete test windows before the period
    top = last if expanding else F.least(last, F.floor(i / F.lit(test)).cast("int") + 1)
    lines = F.array(F.struct(F.greatest(behind + 2, F.lit(1)).alias("lo"), top.alias("hi"), F.lit("train").alias("role")),
                    F.struct((behind + 1).alias("lo"), F.least(behind + 1, last).alias("hi"), F.lit("test").alias("role")))
    spans = days.select(period, F.explode(lines).alias("s")).where("s.lo >= 1 and s.lo <= s.hi")
    return spans.select(F.explode(F.sequence("s.lo", "s.hi")).alias("fold"), period, F.col("s.role").alias("role"))


def numbered(periods: DataFrame, period: str) -> DataFrame:
    """``period, _i, _n``: each different period with its place from 0 and their number. A calendar is small."""
    every = Window.partitionBy(F.lit(0))
    return periods.select(period).distinct().select(
        period, (F.row_number().over(every.orderBy(period)) - 1).alias("_i"), F.count(F.lit(1)).over(every).alias("_n"))


def contract(df: DataFrame, target: str, ts: str | None = None, entity: str | None = None,
             metric: str | None = None, seed: int = 42, n_folds: int = 5, holdout_frac: float = 0.15) -> DataFrame:
    """One row naming task, split strategy and metric for a table; a stated metric wins over the default."""
    task, rate = "classification", None
    if is_numeric(df, target):
        few = [r[0] for r in df.select(F.col(target).cast("double")).where(~is_null(df, target)).distinct().limit(21)
               .collect()]
        if len(few) > 20:
            task = "regression"
        elif len(few) == 2:
            low, high = sorted(few)
            s = collect_stats(df, [F.count_if(F.col(target) == low).alias("lo"), F.count_if(F.col(target) == high).alias("hi"),
                                   F.avg(F.col(target).cast("double")).alias("mean")])
            n = s["lo"] + s["hi"]
            rate = s["mean"] if low == 0 else min(s["lo"], s["hi"]) / n
    has_ts, has_entity = ts in df.columns if ts else False, entity in df.columns if entity else False
    strategy = ("temporal-entity-aware" if has_ts and has_entity else "temporal" if has_ts else
                "entity-grouped" if has_entity else "random")
    if metric and metric != "auto":
        chosen, source = metric, "user"
    else:
        source = "auto"
        chosen = ("neg_rmse" if task == "regression" else
                  "average_precision" if rate is not None and rate < RARE else "roc_auc")
    row = (target, task, None if rate is None else round(rate, 6), chosen, source, strategy, seed, n_folds,
           holdout_frac)
    return df.sparkSession.createDataFrame([row], (
        "target string, task string, positive_rate double, metric string, metric_source string, "
        "split_strategy string, seed int, n_folds int, holdout_frac double"))
