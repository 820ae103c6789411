"""Contributions of a linear score, their attribution to feature families, reason codes and permutation importance."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from firmground.functions.coding import numbered
from firmground.functions.columns import attach, md5_bucket
from firmground.sources.scratch import stored


def _contributions(df: DataFrame, coefs: dict[str, float]) -> DataFrame:
    """Adds ``_parts``: an array of (feature, contribution) structs of each row, nulls read as 0."""
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in coefs}
    means = df.agg(*[F.avg(c).alias(f"_m_{f}") for f, c in x.items()])
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (x[f] - F.col(f"_m_{f}"))).alias("contribution"))
                      for f, w in coefs.items()])
    full = attach(df, means)
    return full.withColumn("_parts", parts).select(*df.columns, "_parts")


def linear_contrib(df: DataFrame, key: list[str], coefs: dict[str, float]) -> DataFrame:
    """``key…, feature, contribution`` = coefficient times distance from the mean: exact for a linear margin."""
    return _contributions(df, coefs).select(*key, F.explode("_parts").alias("p")).select(*key, "p.*")


def family_attr(contrib: DataFrame, catalog: DataFrame) -> DataFrame:
    """``family, total, pct, n_features`` of the mean absolute contributions, largest first."""
    per = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("v"))
    named = per.join(catalog.select("feature", "family"), "feature", "left").withColumn(
        "family", F.coalesce("family", F.lit("uncatalogued")))
    fam = named.groupBy("family").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n_features"))
    return attach(fam, named.agg(F.sum("v").alias("_all"))).select(
        "family", "total", F.coalesce(F.try_divide(100 * F.col("total"), "_all"), F.lit(0.0)).alias("pct"), "n_features"
    ).orderBy(F.desc("total"), "family")


def reason_codes(df: DataFrame, key: list[str], coefs: dict[str, float], catalog: DataFrame, k: int = 5) -> DataFrame:
    """``key…, rank, feature, family, contribution, direction, reason``: the k strongest contributions of each row.

    Ranking happens inside the row's own array, so no row is shuffled; the catalog is cut to one row per coefficient,
    which bounds what is broadcast.
    """
    strong = F.slice(F.array_sort("_parts", lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(
        F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).when(
        a["feature"] > b["feature"], 1).otherwise(0)), 1, k)
    ranked = _contributions(df, coefs).select(*key, F.posexplode(strong).alias("_i", "p")).select(
        *key, (F.col("_i") + 1).alias("rank"), "p.*")
    known = catalog.where(F.col("feature").isin(list(coefs))).groupBy("feature").agg(
        F.first("family").alias("family"), F.first("rationale").alias("rationale"))
    told = ranked.join(F.broadcast(known), "feature", "left")
    family = F.coalesce("family", F.lit("uncatalogued"))
    return told.select(
        *key, "rank", "feature", family.alias("family"), "contribution",
        F.when(F.col("contribution") > 0, "increases").otherwise("decreases").alias("direction"),
        F.concat(F.coalesce("rationale", F.concat(F.lit("feature: "), "feature")), F.lit(" ("), family, F.lit(" family)")).alias("reason"))


def wide_reasons(codes: DataFrame, key: list[str], k: int) -> DataFrame:
    """One row per case with ``reason_1_feature … reason_k_direction`` columns."""
    cols = []
    for i in range(1, k + 1):
        cols += [F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"reason_{i}_{c}") for c in ("feature", "contribution", "direction")]
    return codes.groupBy(*key).agg(*cols)


def permutation_importance(df: DataFrame, key: list[str], features: list[str], score: Callable[[DataFrame], DataFrame],
                           metric: Callable[[DataFrame], DataFrame], seed: int = 7, inputs: list[str] | None = None) -> DataFrame:
    """``feature, base, permuted, importance``: drop of the metric when one column is shuffled over all rows.

    ``score`` adds the prediction to a frame, ``metric`` returns one row with ``value``; both read the columns ``inputs``, all by
    default. Rows are numbered along a hash of the key, and once more along a hash of its own for every feature, whose
    values then go to the row of the same number. Of equal hashes, the order is that of the key and, where a key repeats, of
    all columns.
    """
    inputs = list(dict.fromkeys([*(inputs or df.columns), *features]))
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    repeats = df.groupBy(F.xxhash64(*key).alias("_k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    ties = [*key, *[c for c in plain if c not in key]] if repeats else key
    text = F.concat_ws(",", *[F.col(k).cast("string") for k in key])

    def line(name: str, keep: list[str]) -> DataFrame:
        hashed = df.select(*dict.fromkeys([*ties, *keep]), md5_bucket(text, 2**31 - 1, f"{seed}:{name}").alias("_h"))
        return numbered(hashed, ["_h", *ties], "_n", "shuffled", keep)

    mixed = line("home", inputs)
    for i, f in enumerate(features):
        mixed = mixed.join(line(f, [f]).withColumnRenamed(f, f"_moved{i}"), "_n")
    mixed = stored(mixed.drop("_n"), "moved")
    base = metric(score(df)).select(F.col("value").alias("base"))
    out = None
    for i, f in enumerate(features):
        one = mixed.withColumn(f, F.col(f"_moved{i}")).select(*inputs)
        row = attach(metric(score(one)).select(F.lit(f).alias("feature"), F.col("value").alias("permuted")), base)
        row = row.select("feature", "base", "permuted", (F.col("base") - F.col("permuted")).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out


def linear_score(coefs: dict[str, float], intercept: float) -> Column:
    """Logistic score of a linear margin as one column expression."""
    margin = F.lit(float(intercept))
    for f, w in coefs.items():
        margin = margin + F.lit(float(w)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-margin))
