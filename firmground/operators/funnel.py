"""Staged feature screen: cheap checks first, each later stage sees only the survivors.

Column statistics come from a few jobs over the full table whatever the number of candidates; the order-dependent
rules are then replayed on those statistics. Every stage returns verdicts ``(feature, survived, score, reason)``.
"""
from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from firmground.functions.boosting import Boosted
from firmground.functions.coding import label_codes, with_codes
from firmground.functions.columns import as_double, attach, collect_stats, is_null, is_numeric, micros, pearson
from firmground.functions.heavy import cell_counts, heavy_counts
from firmground.operators.audit import duplicate_columns, pair_correlations
from firmground.operators.leakage import post_outcome_name
from firmground.operators.metrics import neg_rmse, ranking
from firmground.operators.signal import auc_signal
from firmground.operators.splits import kfold
from firmground.sources.scratch import stored

Verdict = tuple[str, bool, float | None, str]
TRAIL = "stage int, feature string, survived boolean, score double, reason string"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def kept(verdicts: list[Verdict]) -> list[str]:
    return [v[0] for v in verdicts if v[1]]


def stage0_leakage(df: DataFrame, target: str, candidates: list[str], cutoff: float = 0.98) -> list[Verdict]:
    """Evict post-outcome names, and numeric columns correlating with the target at the cutoff or above."""
    open_cols = [c for c in candidates if not post_outcome_name(c)]
    num = [c for c in open_cols if is_numeric(df, c)] if is_numeric(df, target) else []
    corr = collect_stats(df, [pearson(as_double(df, c), as_double(df, target)).alias(c) for c in num]) if num else {}
    out: list[Verdict] = []
    for c in candidates:
        r = corr.get(c)
        r = None if r is None or r != r else abs(r)
        if c not in open_cols:
            out.append((c, False, None, "name"))
        elif r is not None and r >= cutoff:
            out.append((c, False, r, "corr"))
        else:
            out.append((c, True, r, ""))
    return out


def column_counts(df: DataFrame, cols: list[str], near: float = 0.99) -> dict:
    """Rows, nulls and the largest value count (null as a value) of each column, and the distinct known values of text.

    ``top`` is exact where it is ``proved``, which it is at a share of ``near`` or more. Only text cells are shuffled.
    """
    if not cols:
        return {}
    found = heavy_counts(df, cols, near)
    text = [c for c in cols if is_text(df, c)]
    for r in cell_counts(df, text).collect() if text else []:
        found[r["column"]] |= {"top": r["top"], "distinct": r["distinct"], "proved": True}
    return {c: x for c, x in found.items() if x["rows"]}


def stage1_degenerate(df: DataFrame, candidates: list[str], key: list[str], near: float = 0.99,
                      stats: dict | None = None) -> list[Verdict]:
    """Evict near-constant columns, and columns identical to an earlier candidate that was kept."""
    stats = stats or column_counts(df, candidates, near)
    share = {c: stats[c]["top"] / stats[c]["rows"] if c in stats else 1.0 for c in candidates}
    varied = [c for c in candidates if share[c] < near]
    dup = dict(duplicate_columns(df, key, varied)) if varied else {}
    told = [c for c in varied if not stats[c]["proved"]]  # their share is only reported
    share |= {r["column"]: r["top"] / r["rows"] for r in cell_counts(df, told).collect()} if told else {}
    return [(c, False, share[c], "near_constant") if share[c] >= near else
            (c, False, share[c], f"duplicate_of:{dup[c]}") if c in dup else (c, True, share[c], "")
            for c in candidates]


def stage2_missing(df: DataFrame, candidates: list[str], limit: float = 0.8, stats: dict | None = None) -> list[Verdict]:
    if stats is None:
        got = collect_stats(df, [F.avg(is_null(df, c).cast("int")).alias(c) for c in candidates])
    else:
        got = {c: stats[c]["nulls"] / stats[c]["rows"] for c in candidates}
    return [(c, got[c] < limit, got[c], "" if got[c] < limit else "missing") for c in candidates]


def stage3_cardinality(df: DataFrame, candidates: list[str], limit: int = 100, stats: dict | None = None) -> list[Verdict]:
    text = [c for c in candidates if is_text(df, c)]
    stats = stats or column_counts(df, text)
    out: list[Verdict] = []
    for c in candidates:
        k = stats[c]["distinct"] if c in text else None
        bad = k is not None and k > limit
        out.append((c, not bad, None if k is None else float(k), "cardinality" if bad else ""))
    return out


def _group_mean_spread(df: DataFrame, target: str, cols: list[str], by: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("c")
    means = df.select(*by, F.col(target).cast("double").alias("_y"), cells).where("c.value is not null").groupBy(
        *by, "c.column", "c.value").agg(F.avg("_y").alias("m"))
    return means.groupBy(*by, "column").agg(F.stddev_samp("m").alias("score"))


def univariate(df: DataFrame, target: str, candidates: list[str], by: list[str] | None = None) -> dict:
    """Score per candidate, or per (group, candidate) when grouped by one column.

    Numeric: |correlation|; with a rare positive class (under 5%) 2 |AUC - 0.5|; text: spread of the target means.
    """
    by = by or []
    num = [c for c in candidates if is_numeric(df, c)]
    text = [c for c in candidates if c not in num]
    y = as_double(df, target)
    scores: dict = {}
    facts = df.groupBy(*by).agg(
        F.avg(y).alias("_rate"), F.min(y).alias("_lo"), F.max(y).alias("_hi"),
        F.bool_and((y == F.lit(0.0)) | (y == F.lit(1.0))).alias("_bin"), F.count(F.lit(1)).alias("_n"),
        *[F.abs(pearson(as_double(df, c), y)).alias(f"_r_{c}") for c in num]).collect()
    for row in facts:
        group = row[by[0]] if by else None
        rare = row["_bin"] and row["_lo"] != row["_hi"] and row["_rate"] < 0.05
        part: dict = {"_n": row["_n"]}
        if rare and num:
            mine = df.where(F.col(by[0]) == group) if by else df
            got = auc_signal(mine.withColumn("_y", y), "_y", num).collect()
            part.update({r["column"]: r["score"] or 0.0 for r in got})
        else:
            part.update({c: row[f"_r_{c}"] if row[f"_r_{c}"] is not None and row[f"_r_{c}"] == row[f"_r_{c}"] else 0.0
                         for c in num})
        scores[group] = part
    if text:
        for r in _group_mean_spread(df, target, text, by).collect():
            scores[r[by[0]] if by else None][r["column"]] = r["score"] or 0.0
    for part in scores.values():
        for c in candidates:
            part.setdefault(c, 0.0)
    return scores if by else scores[None]


def stage4_signal(df: DataFrame, target: str, candidates: list[str]) -> list[Verdict]:
    """Rank only; nothing is evicted."""
    scores = univariate(df, target, candidates)
    return [(c, True, scores[c], "") for c in candidates]


def stage5_redundancy(df: DataFrame, candidates: list[str], cutoff: float = 0.9) -> list[Verdict]:
    """In candidate order, evict a numeric column correlating at the cutoff with one already kept."""
    num = [c for c in candidates if is_numeric(df, c)]
    table = {}
    if len(num) > 1:
        for r in pair_correlations(df, {c: as_double(df, c) for c in num}).where(F.abs("r") >= cutoff).collect():
            table[(r["col_a"], r["col_b"])] = abs(r["r"])
    keep: list[str] = []
    verdicts: dict[str, Verdict] = {}
    for c in num:
        twin = next((k for k in keep if (k, c) in table), None)
        if twin is None:
            keep.append(c)
            verdicts[c] = (c, True, None, "")
        else:
            verdicts[c] = (c, False, table[(twin, c)], f"redundant_with:{twin}")
    return [verdicts.get(c, (c, True, None, "")) for c in candidates]


def run(df: DataFrame, target: str, candidates: list[str], key: list[str]) -> DataFrame:
    """Stages 0 to 5 in order; the trail has one row per stage and candidate that reached it. Stages read a stored copy of
    the columns concerned, so what makes the frame (joins, often) runs once."""
    trail: list[tuple] = []
    df = stored(df.select(*dict.fromkeys([*key, target, *candidates])), "screened")

    def note(stage: int, verdicts: list[Verdict]) -> list[str]:
        trail.extend((stage, *v) for v in verdicts)
        return kept(verdicts)

    left = note(0, stage0_leakage(df, target, candidates))
    stats = column_counts(df, left)
    left = note(1, stage1_degenerate(df, left, key, stats=stats))
    left = note(2, stage2_missing(df, left, stats=stats))
    left = note(3, stage3_cardinality(df, left, stats=stats))
    note(4, stage4_signal(df, target, left))
    note(5, stage5_redundancy(df, left))
    return df.sparkSession.createDataFrame(trail, TRAIL)


def stage_counts(trail: DataFrame) -> DataFrame:
    return trail.groupBy("stage").agg(F.count(F.lit(1)).alias("entered"), F.count_if("survived").alias("survivors"))


def encoded(df: DataFrame, candidates: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Codes of the text candidates (the most frequent label is 0) and the frame with one numeric column per candidate."""
    text = [c for c in candidates if is_text(df, c)]
    codes = label_codes(df, text, frequent_first=True) if text else None
    return codes, apply_encoding(df, candidates, codes)


def apply_encoding(df: DataFrame, candidates: list[str], codes: DataFrame | None) -> DataFrame:
    """Numbers as they are, text by its code, an unseen label as the next code, null as -1."""
    text = [c for c in candidates if is_text(df, c)]
    out = with_codes(df, codes, {c: f"_i_{c}" for c in text}) if text else df
    return out.withColumns({
        f"_x_{c}": F.when(is_null(df, c), F.lit(-1.0)).otherwise(
            (F.col(f"_i_{c}") if c in text else F.col(c)).cast("double")) for c in candidates})


def stage6_importance(df: DataFrame, target: str, candidates: list[str], order: Column, key: str,
                      task: str = "classification", folds: int = 5, trees: int = 50, seed: int = 7) -> DataFrame:
    """``feature, importance``: boosted-tree importance averaged over contiguous folds; ranks only."""
    used = stored(df.select(*dict.fromkeys([*candidates, target, key]), order.alias("_order")), "folds")
    _, ready = encoded(kfold(used, F.col("_order"), key, folds, "_fold"), candidates)
    grown = Boosted(ready, [f"_x_{c}" for c in candidates], target, task, ["_fold"])
    total = [0.0] * len(candidates)
    for f in range(1, folds + 1):
        model = grown.fit(trees, seed, part=F.col("_fold") != f)
        total = [a + b for a, b in zip(total, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(
        [(c, float(v) / folds) for c, v in zip(candidates, total)], "feature string, importance double")


def stage7_stability(df: DataFrame, target: str, candidates: list[str], ts: str, key: str, slices: int = 3,
                     limit: float = 0.4) -> list[Verdict]:
    """Evict columns whose univariate score moves by the limit or more between equal time slices of 5+ rows."""
    sliced = kfold(df, micros(ts), key, slices, "_slice")
    scores = [s for s in univariate(sliced, target, candidates, ["_slice"]).values() if s["_n"] >= 5]
    if len(scores) < 2:
        return [(c, True, None, "too_few_slices") for c in candidates]
    out: list[Verdict] = []
    for c in candidates:
        move = max(s[c] for s in scores) - min(s[c] for s in scores)
        out.append((c, move < limit, move, "unstable" if move >= limit else ""))
    return out


def stage8_sign_off(candidates: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidates ``feature`` against the names a domain owner confirmed."""
    mark = signed.select("feature").distinct().withColumn("_ok", F.lit(True))
    ok = F.coalesce("_ok", F.lit(False))
    return candidates.join(mark, "feature", "left").select(
        F.lit(8).alias("stage"), "feature", ok.alias("survived"), F.lit(None).cast("double").alias("score"),
        F.when(ok, "").otherwise("no_sign_off").alias("reason"))


def stage9_serving(catalog: DataFrame, max_cost: float | None = None, need_online: bool = True) -> DataFrame:
    """Catalog rows ``feature, cost, online_available``: not servable online, or over the cost budget."""
    offline = ~F.coalesce("online_available", F.lit(True)) if need_online else F.lit(False)
    dear = F.coalesce("cost", F.lit(0.0)) > max_cost if max_cost is not None else F.lit(False)
    reason = F.when(offline, "offline").when(dear, "cost").otherwise("")
    return catalog.select(F.lit(9).alias("stage"), "feature", (reason == "").alias("survived"),
                          F.col("cost").cast("double").alias("score"), reason.alias("reason"))


def stage10_confirm(train: DataFrame, held: DataFrame, target: str, candidates: list[str], campaign: str,
                    scores_path: str, task: str = "classification", trees: int = 50, seed: int = 7) -> DataFrame:
    """Fit on train, score the holdout once per campaign: ``campaign, metric, score``.

    The touch is recorded before anything is read, in a folder that may be written once: a run that dies while scoring
    has used the holdout, and a second run is refused.
    """
    spark = train.sparkSession
    schema = "campaign string, metric string, score double"
    mark = hashlib.md5(campaign.encode()).hexdigest()
    try:
        spark.createDataFrame([(campaign,)], "campaign string").write.mode("error").parquet(f"{scores_path}-touched/{mark}")
    except AnalysisException as e:
        raise RuntimeError(f"holdout already used by campaign {campaign}") from e
    codes, ready = encoded(stored(train.select(*dict.fromkeys([*candidates, target])), "train"), candidates)
    grown = Boosted(ready, [f"_x_{c}" for c in candidates], target, task)
    scored = grown.score(grown.fit(trees, seed), apply_encoding(held, candidates, codes), target, task == "classification")
    if task == "classification":
        p = scored.select(F.col("_label").alias("y"), vector_to_array("probability")[1].alias("p"), "_weight")
        result = ranking(p, "y", "p", weight="_weight").select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("score"))
    else:
        p = scored.select(F.col("_label").alias("y"), F.col("prediction").alias("p"))
        result = neg_rmse(p, "y", "p").select("metric", F.col("value").alias("score"))
    result.select(F.lit(campaign).alias("campaign"), "metric", "score").write.mode("append").parquet(scores_path)
    return spark.read.schema(schema).parquet(scores_path).where(F.col("campaign") == campaign)


def stop_rule(lifts: DataFrame, folds: DataFrame, lift: str = "lift", score: str = "score") -> DataFrame:
    """``best_lift, se, stop``: stop when the best lift is under the cross-fold standard error."""
    best = lifts.agg(F.max(lift).alias("best_lift"))
    se = folds.agg(F.try_divide(F.stddev_samp(score), F.sqrt(F.count(score))).alias("se"))
    return attach(best, se).withColumn("stop", F.col("best_lift") < F.col("se"))
