"""Golden values, planted defects and invariants of the operators."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firmground.functions.stats import normal_p, student_p
from firmground.operators import (
    audit as A, baselines as BL, bootstrap as B, calibrate as C, champion as CH, decide as D, funnel as N, leakage as L,
    metrics as M, monitor as W, pit as P, signal as S, splits as SP,
)
from firmground.sources import snapshots


@pytest.fixture(scope="module")
def structure(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [("ab"[i % 2] if i < 4 else "c", start + dt.timedelta(days=30 * i), None if i == 5 else "x", "pq"[i % 2]) for i in range(6)]
    return spark.createDataFrame(rows, "entity string, event_time timestamp, link string, cohort string")


def test_structure_probes(structure):
    assert A.linkage_density(structure, "link").first()[0] == pytest.approx(5 / 6)
    assert A.event_density(structure, "entity", "event_time").first()["p50"] == 2.0
    assert tuple(A.window_coverage(structure, "event_time", 100).first()) == (150, True)
    assert tuple(A.cohort_size(structure, "cohort", 3).first()) == (3, True)
    assert A.cohort_size(structure, "cohort", 4).first()["passed"] is False


@pytest.fixture(scope="module")
def funnel_frame(spark):
    rng = np.random.default_rng(7)
    n = 400
    y = rng.integers(0, 2, n)
    good = y + rng.normal(0, 1.2, n)
    pdf = pd.DataFrame({
        "id": np.arange(n), "signal_good": good, "leak_perfect": y, "near_constant": (np.arange(n) == 3).astype(int),
        "high_card_str": [f"v{i}" for i in range(n)], "mostly_missing": np.where(np.arange(n) < 5, 1.0, np.nan),
        "dup_of_signal_good": good, "event_time": pd.date_range("2024-01-01", periods=n), "target": y})
    return spark.createDataFrame(pdf).repartition(3)


CANDS = ["signal_good", "leak_perfect", "near_constant", "high_card_str", "mostly_missing", "dup_of_signal_good"]


def test_funnel_evicts_each_planted_column(funnel_frame):
    trail = N.run(funnel_frame, "target", CANDS, ["id"]).toPandas()
    out = {r.feature: (r.stage, r.reason.split(":")[0]) for r in trail[~trail.survived].itertuples()}
    assert out == {"leak_perfect": (0, "corr"), "near_constant": (1, "near_constant"), "dup_of_signal_good": (1, "duplicate_of"),
                   "mostly_missing": (2, "missing"), "high_card_str": (3, "cardinality")}
    assert set(trail[(trail.stage == 5) & trail.survived].feature) == {"signal_good"}


def test_unstable_signal(funnel_frame):
    early = F.col("event_time") < F.lit("2024-07-01").cast("timestamp")
    df = funnel_frame.withColumn("unstable", F.when(early, F.col("target").cast("double")).otherwise(F.pmod(F.hash("id"), F.lit(7)).cast("double")))
    verdicts = dict((v[0], v[1]) for v in N.stage7_stability(df, "target", ["signal_good", "unstable"], "event_time", "id"))
    assert verdicts == {"signal_good": True, "unstable": False}


def test_redundancy_keeps_first(spark):
    rng = np.random.default_rng(0)
    a, b, d = rng.normal(size=(3, 500))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + 0.1 * rng.normal(size=500), "d": d, "e": ["x"] * 500}))
    verdicts = {v[0]: v for v in N.stage5_redundancy(df, ["a", "b", "c", "d", "e"])}
    assert [c for c, v in verdicts.items() if not v[1]] == ["c"] and verdicts["c"][3] == "redundant_with:a"


def test_planted_duplicates_and_overlap(spark):
    base = spark.range(1000).select(F.col("id").alias("order_id"), (F.col("id") % 100).alias("user_id"))
    g = A.grain_check(base.unionByName(base.where("order_id % 5 = 0")), ["order_id"]).first()
    assert (g["dup_rows"], g["passed"]) == (200, False)
    o = L.split_overlap(base.where("user_id < 60"), base.where("user_id >= 56"), "user_id").first()
    assert (o["n_a"], o["n_b"], o["n_both"], o["examples"]) == (60, 44, 4, "56,57,58,59")


def test_null_pattern_leak(spark):
    df = spark.range(2000).withColumn("y", (F.col("id") % 5 == 0).cast("int")).withColumn("why", F.when(F.col("y") == 1, "closed"))
    assert tuple(L.null_pattern(df, "why", "y").first()) == (1.0, True)


def scored(spark, n=2000, seed=5):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.05, 0.95, n).round(3)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "y": (rng.random(n) < p).astype(int), "p": p,
                                               "q": rng.uniform(0, 1, n).round(3)}))


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_ap(y, p):
    total = 0.0
    for t in np.unique(p)[::-1]:
        on = p >= t
        total += y[p == t].sum() / y.sum() * y[on].mean()
    return total


def test_ranking_metrics(spark):
    df = scored(spark)
    pdf = df.toPandas()
    row = M.ranking(df, "y", "p").first()
    assert row["auc"] == pytest.approx(brute_auc(pdf.y.to_numpy(), pdf.p.to_numpy()))
    assert row["ap"] == pytest.approx(brute_ap(pdf.y.to_numpy(), pdf.p.to_numpy()))
    one = M.ranking(df.where("y = 1"), "y", "p").first()
    assert one["auc"] is None and one["ap"] is None


def test_calibration_verdicts(spark):
    assert C.calibration_summary(scored(spark), "y", "p").first()["ece"] < 0.05
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1000)
    squeezed = spark.createDataFrame(pd.DataFrame({"y": y, "p": np.clip(np.where(y, 0.47, 0.43) + rng.normal(0, 0.03, 1000), 0, 1)}))
    assert C.calibration_summary(squeezed, "y", "p").first()["ece"] > 0.04


def test_platt_and_isotonic(spark):
    df = scored(spark).withColumn("s", F.col("p") * F.col("p"))
    platt = C.platt_fit(df, "y", "s")
    assert platt.slope > 0
    iso = C.isotonic_fit(df, "y", "s").apply(df, "s", "c").select("s", "c").distinct().orderBy("s").toPandas()
    assert iso.c.is_monotonic_increasing and iso.c.between(0, 1).all()
    with pytest.raises(ValueError):
        C.isotonic_fit(df.where("id < 100"), "y", "s")


@pytest.mark.parametrize("metric", ["roc_auc", "average_precision", "f1"])
def test_bootstrap_is_repeatable_and_covers_the_point(spark, metric, monkeypatch):
    monkeypatch.setattr(B, "CELLS", 100)
    df = scored(spark)
    a = B.bootstrap_ci(df.repartition(1), "y", "p", metric, 300, 0.9, 42).first()
    b = B.bootstrap_ci(df.repartition(7), "y", "p", metric, 300, 0.9, 42).first()
    assert a["lower"] == pytest.approx(b["lower"], abs=1e-12) and a["upper"] == pytest.approx(b["upper"], abs=1e-12)
    assert a["lower"] < a["point"] < a["upper"] and a["n_boot"] == 300


def test_bootstrap_interval_matches_row_resampling(spark):
    df = scored(spark)
    pdf = df.toPandas()
    rng = np.random.default_rng(0)
    y, p = pdf.y.to_numpy(), pdf.p.to_numpy()
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    vals = []
    for _ in range(400):
        i = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        vals.append(brute_auc(y[i], p[i]))
    got = B.bootstrap_ci(df, "y", "p", "roc_auc", 1000).first()
    lo, hi = np.percentile(vals, [5, 95])
    assert got["lower"] == pytest.approx(lo, abs=0.004) and got["upper"] == pytest.approx(hi, abs=0.004)


def test_bootstrap_needs_both_classes(spark):
    r = B.bootstrap_ci(scored(spark).where("y = 1"), "y", "p", "roc_auc", 50).first()
    assert r["lower"] is None and r["n_boot"] == 0


@pytest.mark.parametrize("metric", ["roc_auc", "average_precision", "f1"])
@pytest.mark.parametrize("cells", [100, 40])
def test_paired_bootstrap_split_into_chunks_changes_nothing(spark, metric, cells, monkeypatch):
    df = scored(spark).withColumn("p", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("p")))
    whole = B.paired_bootstrap(df, "y", "p", "q", metric, 260).first()
    monkeypatch.setattr(B, "CELLS", cells)
    split = B.paired_bootstrap(df.repartition(5), "y", "p", "q", metric, 260).first()
    for c in ("delta", "lower", "upper"):
        assert split[c] == pytest.approx(whole[c], abs=1e-9)


def test_paired_bootstrap_verdicts(spark):
    df = scored(spark).withColumn("same", F.col("p"))
    assert B.paired_bootstrap(df, "y", "p", "q", "rmse", 300, 0.95).first()["verdict"] == "win"
    assert B.paired_bootstrap(df, "y", "q", "p", "roc_auc", 300, 0.95).first()["verdict"] == "loss"
    assert B.paired_bootstrap(df, "y", "same", "p", "mae", 300, 0.95).first()["verdict"] == "no difference"


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.03]
    got = B.adjust_pvalues(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double"), "p").orderBy("i").toPandas()
    order = np.argsort(p)
    adj = np.minimum.accumulate((np.array(p)[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    want = np.empty(6)
    want[order] = adj
    assert np.allclose(got.adjusted, want)


def test_tail_probabilities(spark):
    row = spark.createDataFrame([(1.959963984540054, 2.228138852, 10.0)], "z double, t double, k double").select(
        normal_p("z"), student_p("t", "k")).first()
    assert row[0] == pytest.approx(0.05, abs=1e-9) and row[1] == pytest.approx(0.05, abs=1e-6)


def test_splits_cover_and_do_not_overlap(spark):
    df = spark.range(997).select(F.col("id"), (F.col("id") % 50).alias("e"), F.timestamp_seconds(F.pmod(F.hash("id"), F.lit(90))).alias("ts"))
    for out in (SP.temporal_split(df, "ts", "id"), SP.random_split(df, "id", 0.2, 3), SP.three_way_split(df, "ts", "id")):
        got = out.groupBy("split").count().toPandas().set_index("split")["count"]
        assert got.sum() == 997 and got["test"] == 997 - int(997 * 0.8)
    sides = SP.entity_split(df, "e").groupBy("e").agg(F.count_distinct("split").alias("k")).agg(F.max("k")).first()[0]
    assert sides == 1
    sizes = SP.kfold(df, F.unix_micros("ts"), "id", 5).groupBy("fold").count().orderBy("fold").toPandas()["count"].tolist()
    assert sizes == [200, 200, 199, 199, 199]


def test_splits_of_equal_rows_and_text_keys(spark):
    one = spark.range(100).select(F.lit(5).cast("timestamp").alias("ts"), F.lit(1).alias("k"))
    sizes = {r["split"]: r["count"] for r in SP.temporal_split(one, "ts", "k").groupBy("split").count().collect()}
    assert sizes == {"train": 80, "test": 20}
    assert [r["count"] for r in SP.kfold(one, F.unix_micros("ts"), "k", 7).groupBy("fold").count().orderBy("fold").collect()] == [15, 15, 14, 14, 14, 14, 14]
    text = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.timestamp_seconds(F.col("id") % 2).alias("ts"))
    got = SP.temporal_split(text, "ts", "k").toPandas()
    assert (got["split"] == "test").sum() == 10 and got[got["split"] == "test"].ts.nunique() == 1


def events(spark, n=1500):
    rng = np.random.default_rng(2)
    who = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 12, n))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24, n), unit="h")
    return spark.createDataFrame(pd.DataFrame({"u": who, "ts": ts, "id": np.arange(n), "v": rng.normal(50, 9, n).round(2),
                                               "kind": rng.choice(list("abc"), n)}))


def spine(spark):
    return spark.range(12).select(F.col("id").alias("u"), F.explode(F.array(*[
        F.lit(d).cast("timestamp") for d in ("2024-01-03", "2024-01-12 05:00:00", "2024-01-30")])).alias("d"))


def all_features(sp, ev):
    a = P.aggregation(sp, ev, "u", "d", "ts", 7, "v")
    b = P.asof(sp, ev, "u", "d", "ts", "id", ["v"]).select("u", "d", F.col("v").alias("last_v"))
    c = P.sequence(sp, ev, "u", "d", "ts", "id", "kind", ["a>b", "c>c"])
    e = P.lifetime(sp, ev, "u", "d", "ts").join(P.velocity(sp, ev, "u", "d", "ts", 5, "v"), ["u", "d"])
    return a.join(b, ["u", "d"]).join(c, ["u", "d"]).join(e, ["u", "d"]).orderBy("u", "d").toPandas()


def test_features_do_not_see_the_future(spark):
    sp, ev = spine(spark).where("d < '2024-01-20'"), events(spark)
    cut = ev.where(F.col("ts") < "2024-01-12 05:00:00")
    late = sp.where("d > '2024-01-10'")
    pd.testing.assert_frame_equal(all_features(late, ev), all_features(late, cut))


def test_hot_entities_get_the_same_features(spark, hot):
    sp, ev = spine(spark), events(spark)
    split = all_features(sp, ev)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert len(split) == 36
    pd.testing.assert_frame_equal(split, all_features(sp, ev))


def test_window_sums_against_brute_force(spark):
    sp, ev = spine(spark), events(spark)
    got = P.aggregation(sp, ev, "u", "d", "ts", 7, "v").toPandas()
    pdf = ev.toPandas()
    for r in got.itertuples():
        inside = pdf[(pdf.u == r.u) & (pdf.ts < r.d) & (pdf.ts >= r.d - pd.Timedelta(days=7))].v
        if len(inside) >= 2:
            assert r.v_sum == pytest.approx(inside.sum()) and r.v_max == inside.max() and r.v_std == pytest.approx(inside.std())
        else:
            assert pd.isna(r.v_sum)


def test_threshold_sweep_against_brute_force(spark):
    df = scored(spark)
    pdf = df.toPandas()
    got = D.threshold_sweep(df, "y", "p", {"tp": 5, "fp": -1}, 50).toPandas().sort_values("t")
    for r, t in zip(got.itertuples(), np.linspace(pdf.p.min(), pdf.p.max(), 50)):
        on = pdf.p >= r.t
        assert abs(r.t - t) < 1e-12 and r.tp == ((pdf.y == 1) & on).sum() and r.tn == ((pdf.y == 0) & ~on).sum()


def test_champion_front_and_floor(spark):
    rows = [("g", "gbm", "GradientBoostingClassifier", 0.78, [0.77, 0.78, 0.79]), ("g", "logit", "LogisticRegression", 0.72, [0.7, 0.72, 0.74]),
            ("h", "gbm", "GradientBoostingClassifier", 0.781, [0.7, 0.8, 0.84]), ("h", "logit", "LogisticRegression", 0.78, [0.7, 0.8, 0.84])]
    exp = spark.createDataFrame([(*r, "auc", "c") for r in rows],
                                "grp string, name string, model_type string, metric_value double, fold_scores array<double>, metric_name string, contract_hash string")
    assert {r["grp"]: r["name"] for r in CH.champion(exp, "grp").collect()} == {"g": "gbm", "h": "logit"}
    assert {(r["grp"], r["name"]) for r in CH.pareto(exp, "grp").collect()} == {("g", "gbm"), ("g", "logit"), ("h", "gbm"), ("h", "logit")}
    assert {r["grp"]: r["continue"] for r in CH.se_floor(exp, "grp").collect()} == {"g": True, "h": False}


def test_snapshot_diff(spark):
    def snap(n, name="t"):
        return snapshots.snapshot(spark.range(n).withColumn("event_date", F.lit("2024-01-01").cast("date")), name, "2024-06-01")

    same = snapshots.snapshot_diff(snap(100), snap(100), today="2024-06-02").collect()
    grown = {r["type"]: r["severity"] for r in snapshots.snapshot_diff(snap(100), snap(120), today="2024-06-02").collect()}
    gone = snapshots.snapshot_diff(snap(100), snap(1, "other"), today="2024-06-02").where("name = 't'").collect()
    assert same == [] and grown["rowcount_drift"] == "error" and [(r["type"], r["severity"]) for r in gone] == [("missing", "error")]


def test_psi_is_zero_on_itself_and_flags_a_shift(spark):
    df = scored(spark)
    assert W.psi(df, df, ["p"]).first()["psi"] == pytest.approx(0)
    assert W.psi(df, df.withColumn("p", F.col("p") * 0.5), ["p"]).first()["flagged"] is True


def test_triage_buckets(funnel_frame):
    got = {r["column"]: r["triage_bucket"] for r in S.triage(funnel_frame.drop("event_time"), "target", ["id"]).collect()}
    assert {got[c] for c in ("near_constant", "mostly_missing", "dup_of_signal_good")} == {"DROP-CANDIDATE"}
    assert got["leak_perfect"] == "HIGH-SIGNAL"


def test_baseline_bar(spark):
    df = scored(spark, 600)
    table = BL.baselines(df.where("id < 400"), df.where("id >= 400"), "y", ["p", "q"], "roc_auc", trees=3).toPandas()
    assert table[table.is_bar].baseline.item() in ("logistic", "boosted") and (table[table.baseline == "trivial"].score == 0.5).all()


def test_holdout_is_used_once(spark, tmp_path):
    df = scored(spark, 500)
    args = (df.where("id < 350"), df.where("id >= 350"), "y", ["p"], "camp", str(tmp_path / "scores"))
    assert N.stage10_confirm(*args, trees=2).first()["score"] > 0.5
    with pytest.raises(RuntimeError):
        N.stage10_confirm(*args, trees=2)
