"""Text jobs: recurring keywords, and whether claims and findings carry evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that never form a group.
STOP_WORDS = (
    "the", "a", "an", "is", "to", "of", "for", "and", "in", "on", "at", "no", "not",
    "this", "that", "it", "be", "with", "as", "from", "or", "has", "have", "was",
    "were", "will", "would", "needs", "need", "needed", "until", "than", "so",
    "because", "but", "if", "still", "yet", "more", "once", "just", "here",
)
# What counts as a quantitative claim, as a reference to evidence, as a finding and as its evidence.
CLAIM = (
    r"(?i)(?:^|\s)(\d+\.?\d*\s*%|\$\s*[\d,.]+[KMB]?|[+-]?\d+\.?\d*\s*(?:pp|bps|basis points)"
    r"|(?:AUC|ROC|F1|precision|recall|accuracy|RMSE|MAE|R2|lift|p-value)\s*[=:≈]\s*[\d.]+)"
)
REFERENCE = (
    r"(?i)(\[(?:fig|table|probe|output|notebook|cell|section)\s*[\d:.\w-]+\]|(?:see|from|per|ref)\s+[`'\"]?[\w/.-]+[`'\"]?"
    r"|source:\s*\S+|evidence:\s*\S+|→\s*\S+\.(?:csv|json|png|svg|ipynb|py|sql)|`[^`]+\.(?:csv|json|png|svg|ipynb|py|sql)`)"
)
FINDING = r"(?m)^[-*]\s+.{15,}"
EVIDENCE = (
    r"(?i)(probe:|output:|fig[ure]*[\s:_]|plot[\s:_]|\.png|\.svg|\.csv|cell\s*\d|notebook|\.ipynb|data shows|p[<>=]|n\s*=\s*\d"
    r"|mean\s*=|median\s*=|std\s*=|corr\s*=|\d+%|\d+\.\d+)"
)


CHUNK_ROWS = 20_000


def keyword_groups(df: DataFrame, key: str, text: str, min_count: int = 3, examples: int = 3) -> DataFrame:
    """``token, n, examples``: words of more than two letters that recur over rows, each row counting once.

    Examples are the first keys in order. Words are counted once per chunk of about ``CHUNK_ROWS`` rows, which bounds the
    list of keys of a very common word, and chunks are merged by the thousand.
    """
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "), r"\s+")
    useful = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))
    tokens = df.select(key, F.explode(useful).alias("token"))
    chunks = df.count() // CHUNK_ROWS + 1
    part = tokens.groupBy("token", F.pmod(F.xxhash64(key), F.lit(chunks)).alias("_c")).agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(key)), 1, examples).alias("keys"))
    while chunks > 1:
        chunks = -(-chunks // 1000)
        part = part.groupBy("token", F.floor(F.col("_c") / 1000).alias("_c")).agg(
            F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, examples).alias("keys"))
    return part.where(F.col("n") >= min_count).select("token", "n", F.concat_ws(",", F.col("keys").cast("array<string>")).alias("examples"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def claim_trace(df: DataFrame, key: str, text: str, reach: int = 2, needed: float = 0.9) -> DataFrame:
    """``key, claims, traced, share, passed``: claims with an evidence reference at most ``reach`` lines away.

    All lines of a text are one array of its row, so nothing is shuffled; a text without claims passes.
    """
    lines = df.select(key, F.split(text, "\n").alias("_l")).withColumn(
        "_c", F.transform("_l", lambda s: F.regexp_count(s, F.lit(CLAIM))))

    def near(i: Column) -> Column:
        start = F.greatest(i - reach, F.lit(0))
        return F.concat_ws("\n", F.slice("_l", start + 1, i + reach + 1 - start))

    traced = F.transform("_c", lambda c, i: F.when((c > 0) & F.rlike(near(i), F.lit(REFERENCE)), c).otherwise(0))
    sums = lines.select(key, _total(F.col("_c")).alias("claims"), _total(traced).alias("traced"))
    share = F.try_divide("traced", "claims")
    return sums.select(key, "claims", "traced", share.alias("share"), F.coalesce(share >= needed, F.lit(True)).alias("passed"))


def evidence_share(df: DataFrame, key: str, text: str, needed: float = 0.8) -> DataFrame:
    """``key, findings, backed, share, passed``: bullet lines of substance that name their evidence."""
    found = df.select(key, F.regexp_extract_all(F.col(text), F.lit("(?d)" + FINDING), F.lit(0)).alias("_f"))
    sums = found.select(key, F.size("_f").alias("findings"),
                        F.size(F.filter("_f", lambda s: F.rlike(s, F.lit(EVIDENCE)))).alias("backed"))
    share = F.try_divide("backed", "findings")
    return sums.select(key, "findings", "backed", share.alias("share"), F.coalesce(share >= needed, F.lit(True)).alias("passed"))
