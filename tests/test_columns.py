"""Correlations of many columns, frequent values, and exact keys against plain versions."""
import datetime
import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firmground.functions import gram, heavy
from firmground.operators import audit, funnel


def wide_table(spark, d=40, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.normal(size=(n, 1))
    x[:, 3] = 7.1
    x[:, 4] = 1e9 + rng.integers(0, 3, n)
    x[:, 5] = x[:, 4] * 2
    x[rng.random((n, d)) < 0.2] = np.nan
    x[:, 6] = np.nan
    x[1:, 7] = np.nan
    x[: n // 2, 8] = np.nan
    x[n // 2:, 9] = np.nan
    names = [f"c{i}" for i in range(d)]
    frame = pd.DataFrame(x, columns=names)
    rows = [tuple(None if v != v and (i + j) % 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    return frame, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5), names


def check(frame, got):
    want = frame.corr(min_periods=2)
    for r in got:
        a, b = frame[r.col_a], frame[r.col_b]
        both = a.notna() & b.notna()
        flat = both.sum() < 2 or a[both].nunique() < 2 or b[both].nunique() < 2
        if flat:
            assert r.r is None, r
        elif "c4" in (r.col_a, r.col_b) or "c5" in (r.col_a, r.col_b):  # pandas itself loses digits here
            x, y = (v[both] - v[both].mean() for v in (a - 1e9 * (r.col_a == "c4") - 2e9 * (r.col_a == "c5"), b - 1e9 * (r.col_b == "c4") - 2e9 * (r.col_b == "c5")))
            assert r.r == pytest.approx((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()), abs=1e-7)
        else:
            assert r.r == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-9), r


def test_many_correlations(spark, monkeypatch):
    frame, df, names = wide_table(spark)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    for wide in (1024, 20, 12, 26):
        monkeypatch.setattr(gram, "WIDE", wide)
        got = audit.corr_matrix(df, names).collect()
        assert sorted((r.col_a, r.col_b) for r in got) == sorted(pairs)
        check(frame, got)
    few = audit.pair_correlations(df, {c: audit.as_double(df, c) for c in names}, size=10**6).collect()
    many = {(r.col_a, r.col_b): r.r for r in gram.correlations(df.select([F.nanvl(c, F.lit(None)).alias(c) for c in names]), names).collect()}
    for r in few:
        if "c3" in (r.col_a, r.col_b):  # a constant with rounding: only the matrix form is sure to see it
            continue
        assert (many[r.col_a, r.col_b] is None) == (r.r is None) and (r.r is None or abs(many[r.col_a, r.col_b] - r.r) < 1e-7)


def test_moments_merge():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((90, 5)) < 0.3, np.nan, rng.normal(size=(90, 5)) + 1e8)
    whole, parts = gram.batch_moments(x), None
    for at in range(0, 90, 7):
        part = gram.batch_moments(x[at:at + 7])
        parts = part if parts is None else gram.merged(parts, part)
    assert np.allclose(whole, parts, rtol=1e-9, atol=1e-5)


def odd_table(spark, n=4000):
    rng = random.Random(5)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        rows.append((
            float("nan") if i % 3 == 0 else -0.0 if i % 3 == 1 else 0.0, 1 if rng.random() < 0.995 else i, rng.choice("abcde"), None, rng.random(), i // 2,
            Decimal(i % 4) / 4, day if i % 10 else day + datetime.timedelta(i), i % 2 == 0, [i % 2], b"x" if i % 5 else b"y", None if i % 2 else "t", day.date()))
    return rows, spark.createDataFrame(rows, (
        "zero double, near int, five string, hollow string, real double, twos long, dec decimal(6,2), ts timestamp, flag boolean, arr array<int>, bin binary, half string, d date")).repartition(4)


def plain_counts(rows, names):
    out = {}
    for c, name in enumerate(names):
        values = [None if r[c] != r[c] else tuple(r[c]) if isinstance(r[c], list) else r[c] for r in rows]
        counts = Counter(values)
        out[name] = (len(rows), max(counts.values()), len(set(values) - {None}), counts[None])
    return out


def test_frequent_values(spark):
    rows, df = odd_table(spark)
    want = plain_counts(rows, df.columns)
    got = {r["column"]: (r["rows"], r["top"], r["distinct"], r["nulls"]) for r in heavy.cell_counts(df, df.columns).collect()}
    assert got == want
    assert heavy.top_counts(df, df.columns) == {c: w[:2] for c, w in want.items()}
    found = heavy.heavy_counts(df, df.columns)
    for c, (n, top, _, nulls) in want.items():
        assert found[c]["rows"] == n and found[c]["nulls"] == nulls and found[c]["top"] <= top
        assert not found[c]["proved"] or found[c]["top"] == top
        assert found[c]["proved"] or top < 0.5 * n or c in ("arr", "bin")
    assert found["near"]["proved"] and found["hollow"]["proved"] and not found["real"]["proved"]
    shares = {r["column"]: r for r in audit.near_constant(df).collect()}
    assert {c for c, r in shares.items() if r["near_constant"]} == {"near", "hollow", "d"}
    assert all(shares[c]["top_share"] == want[c][1] / want[c][0] for c in want)
    assert audit.near_constant(df.limit(0)).count() == 0
    for least in (0.03, 0.2):
        many = heavy.heavy_counts(df, df.columns, least)
        assert all(x["top"] == want[c][1] for c, x in many.items() if x["proved"]) and many["five"]["proved"]
    with pytest.raises(ValueError):
        heavy.heavy_counts(df, ["five"], 0.001)


def test_near_ties_are_not_proved_wrongly(spark):
    rng = random.Random(9)
    for skew in (1.0, 1.2, 2.0):
        values = [int(rng.paretovariate(skew)) % 3000 for _ in range(30_000)]
        df = spark.createDataFrame([(v, str(v)) for v in values], "v int, s string").repartition(6)
        top = max(Counter(values).values())
        assert heavy.top_counts(df, ["v", "s"], 0.03) == {"v": (30_000, top), "s": (30_000, top)}


def test_keys_are_excluded_by_witnesses_only(spark):
    # 0.65 of the values of ``most`` are different; ``key`` repeats nothing, ``once`` repeats one value
    df = spark.range(20_000).select(
        F.col("id").alias("key"), F.when(F.col("id") < 13_000, F.col("id")).otherwise(F.col("id") - 7_000).alias("most"),
        F.when(F.col("id") == 19_999, 3).otherwise(F.col("id")).alias("once"), F.when(F.col("id") > 0, F.col("id").cast("string")).alias("one_null"),
        F.when(F.col("id") > 1, F.col("id").cast("double")).alias("two_nulls"), (F.col("id") / 7).alias("real"), F.lit(1).alias("one"))
    for slices in (1, 64, 10_000):
        assert {r["column"] for r in audit.candidate_keys(df, slices).collect()} == {"key", "one_null", "real"}
    assert audit.candidate_keys(df.select("one")).count() == 0


def test_funnel_counts_shuffle_text_only(spark):
    rows, df = odd_table(spark)
    want = plain_counts(rows, df.columns)
    stats = funnel.column_counts(df, df.columns)
    assert stats["five"]["distinct"] == 5 and "distinct" not in stats["real"]
    verdicts = {v[0]: v[1:] for v in funnel.stage1_degenerate(df.withColumn("id", F.monotonically_increasing_id()), ["near", "five", "real", "twos", "hollow"], ["id"])}
    assert verdicts == {c: (s := want[c][1] / want[c][0], ) and (s < 0.99, s, "near_constant" if s >= 0.99 else "") for c in verdicts}


def test_counts_by_column_equal_counts_of_cells(spark):
    nan = float("nan")
    rows = [(0.0, "x", None, [1]), (-0.0, "x", 3, [1]), (nan, None, 3, [2]), (None, "y", 4, None), (2.5, "y", None, None)]
    df = spark.createDataFrame(rows, "a double, b string, c int, d array<int>")
    got = lambda block: sorted(tuple(r) for r in heavy.cell_counts(df, ["a", "b", "c", "d"], block).collect())
    assert got(50) == got(0) == [("a", 5, 2, 2, 2), ("b", 5, 2, 2, 1), ("c", 5, 2, 2, 2), ("d", 5, 2, 2, 2)]
    assert heavy.cell_counts(df.limit(0), ["a"]).count() == 0
