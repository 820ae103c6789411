"""Paths of the split tree, vectorised tails, and the shared folder."""
import math
import random

import numpy as np
import pandas as pd
import pytest

from firmground.functions import stats
from firmground.operators import bootstrap


def test_tree_paths(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 8, 13):
        totals = [(i, rng.randrange(50), rng.randrange(50)) for i in range(n)]
        found = {r.chunk: r for r in bootstrap.tree_paths(spark.createDataFrame(totals, "chunk long, pos long, neg long"), n - 1, ["pos", "neg"]).collect()}
        depth = (n - 1).bit_length()
        for i in range(n):
            for name, c in (("pos", 1), ("neg", 2)):
                inside = lambda level, node: sum(t[c] for t in totals if t[0] >> (depth - level) == node)
                nodes = [(level, i >> (depth - level)) for level in range(depth + 1)]
                assert list(found[i][f"{name}_whole"]) == [inside(*x) for x in nodes]
                assert list(found[i][f"{name}_left"])[:depth] == [inside(level + 1, 2 * node) for level, node in nodes[:depth]]


def test_draws_are_multinomial_and_agree():
    totals = np.array([30, 0, 10, 60, 5])
    depth, n = 3, len(totals)
    inside = lambda level, node: sum(int(t) for i, t in enumerate(totals) if i >> (depth - level) == node)
    draws = []
    for i in range(n):
        whole = [inside(level, i >> (depth - level)) for level in range(depth + 1)]
        left = [inside(level + 1, 2 * (i >> (depth - level))) for level in range(depth)]
        draws.append(bootstrap.chunk_draws(np.array(whole), np.array(left), i, 4000, (1, 2)))
    inside_all = np.stack([d[1] for d in draws])
    assert (inside_all.sum(axis=0) == totals.sum()).all()
    assert all((draws[i][0] == inside_all[:i].sum(axis=0)).all() for i in range(n))
    assert np.allclose(inside_all.mean(axis=1), totals, atol=0.6)
    assert np.allclose(inside_all.var(axis=1), totals * (1 - totals / totals.sum()), rtol=0.12)


def test_interval_width_is_the_analytic_one(spark):
    """DeLong's variance of the AUC against the stratified interval, over many chunks."""
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.3
    p = np.round(rng.normal(size=3000) + y, 3)
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "p": p}))
    pos, neg = p[y], p[~y]
    wins = (pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)
    se = math.sqrt(wins.mean(axis=1).var(ddof=1) / len(pos) + wins.mean(axis=0).var(ddof=1) / len(neg))
    row = bootstrap.bootstrap_ci(df, "y", "p", "roc_auc", 2000, 0.9).first()
    assert row.point == pytest.approx(wins.mean()) and row.width == pytest.approx(2 * 1.6449 * se, rel=0.06)


def plain_tail(t, k):
    """Two-sided tail of Student's t by numerical integration."""
    x = np.linspace(0, math.atan(abs(t) / math.sqrt(k)), 200_001)
    area = np.trapezoid(np.cos(x) ** (k - 1), x)
    return 1 - 2 * area * math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(math.pi)


def test_student_tails():
    rng = random.Random(1)
    cases = [(rng.uniform(-6, 6), rng.choice([1, 2, 3.5, 10, 77.7, 1000, 250_000])) for _ in range(200)]
    got = stats._student_tail(pd.Series([c[0] for c in cases]), pd.Series([float(c[1]) for c in cases]))
    for (t, k), p in zip(cases, got):
        assert p == pytest.approx(plain_tail(t, k), abs=2e-8)
    odd = stats._student_tail(pd.Series([0.0, None, 1.0, 1.0, math.inf, 40.0]), pd.Series([5.0, 5.0, None, 0.0, 5.0, 1e6]))
    assert odd[0] == pytest.approx(1) and odd[1:4].isna().all() and odd[4] == 0 and 0 <= odd[5] < 1e-300
    assert len(stats._student_tail(pd.Series([], dtype=float), pd.Series([], dtype=float))) == 0


def test_a_cluster_must_name_its_folder():
    from firmground.session import checkpoint_dir

    class Fake:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        checkpoint_dir(Fake)
