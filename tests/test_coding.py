"""Label codes, keyed shuffles, pairing of repeated keys, and spreads of far-apart groups."""
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from firmground.functions.coding import label_codes, numbered, with_codes
from firmground.operators import errors, explain, funnel, monitor, pit, signal


def codes_of(spark, texts, **how):
    df = spark.createDataFrame([(t, "x") for t in texts], "a string, b string").repartition(5)
    found = {}
    for r in label_codes(df, ["a", "b"], **how).collect():
        found.setdefault(r.column, {})[r.label] = r.code
    return df, found


def test_label_codes(spark):
    rng = random.Random(1)
    texts = [None, "", "é", "Z", "z", "\U0001f600", "￿"] + [f"customer#{rng.randrange(400):09d}" for _ in range(3000)]
    df, found = codes_of(spark, texts)
    known = sorted({t for t in texts if t is not None}, key=lambda t: t.encode())
    assert found["a"] == {t: i for i, t in enumerate(known)} and found["b"] == {"x": 0}
    counts = Counter(t for t in texts if t is not None)
    ranked = sorted(known, key=lambda t: (-counts[t], t.encode()))
    assert codes_of(spark, texts, frequent_first=True)[1]["a"] == {t: i for i, t in enumerate(ranked)}
    codes = label_codes(df, ["a", "b"])
    other = spark.createDataFrame([("Z", "x"), ("new", "x"), (None, None)], "a string, b string")
    assert [tuple(r) for r in with_codes(other, codes, {"a": "ca", "b": "cb"}).select("ca", "cb").orderBy("ca").collect()] == [
        (None, None), (found["a"]["Z"], 0.0), (len(known), 0.0)]
    assert label_codes(df.limit(0), ["a"]).count() == 0
    assert with_codes(other, label_codes(df.limit(0), ["a"]), {"a": "c"}).where("c = 0").count() == 2


def test_codes_match_the_estimator(spark):
    from pyspark.ml.feature import StringIndexer

    rng = random.Random(2)
    df = spark.createDataFrame([(f"k{rng.randrange(60) ** 2 // 50}", float(i)) for i in range(2000)], "t string, v double")
    for how, kind in ((False, "alphabetAsc"), (True, "frequencyDesc")):
        model = StringIndexer(inputCol="t", outputCol="want", stringOrderType=kind).fit(df)
        both = model.transform(with_codes(df, label_codes(df, ["t"], frequent_first=how), {"t": "got"}))
        assert both.where("got <> want").count() == 0 and both.count() == 2000
    assert signal.coded_target(df, "t").where("_y is null").count() == 0
    codes, ready = funnel.encoded(df.withColumn("t", F.when(F.col("v") % 7 > 0, F.col("t"))), ["t", "v"])
    assert ready.where("_x_t = -1").count() == 286 and ready.where("_x_t is null or _x_v <> v").count() == 0


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("x"), F.col("id").alias("y")).repartition(7)
    rows = numbered(df, ["x", "y"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1000)) and [(r.x, r.y) for r in rows] == sorted((r.x, r.y) for r in rows)


def test_shadow_pairs_repeated_keys_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (3, None)], "k int, d string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (2, "y"), (None, "x"), (4, "x"), (3, "x"), (3, "x")], "k int, d string")
    got = {(r.champion, r.challenger): r.n for r in monitor.shadow(a, b, ["k"], "d").collect()}
    assert got == {("x", "x"): 2, ("y", "y"): 1, ("x", "y"): 1, (None, "x"): 1}
    many = spark.range(100_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("d"))
    assert {(r.champion, r.challenger, r.n) for r in monitor.shadow(many, many, ["k"], "d").collect()} == {("x", "x", 33334), ("y", "y", 66666)}


def test_permutation_with_repeated_keys_repeats(spark):
    rng = random.Random(3)
    rows = [(i % 40, rng.random(), rng.random(), rng.randrange(2)) for i in range(400)]
    metric = lambda d: d.agg(F.avg(F.col("p") * F.col("y")).alias("value"))
    results = []
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "k int, u double, v double, y int").repartition(parts)
        out = explain.permutation_importance(df, ["k"], ["u", "v"], lambda d: d.withColumn("p", F.col("u")), metric)
        results.append({r.feature: (round(r.permuted, 12), round(r.importance, 12)) for r in out.collect()})
    assert results[0] == results[1] and results[0]["v"][1] == 0 and results[0]["u"][1] != 0
    moved = []
    explain.permutation_importance(df, ["k"], ["u"], lambda d: d.withColumn("p", F.col("u")), lambda d: (moved.append(d), metric(d))[1])
    assert sorted(r.u for r in moved[1].collect()) == sorted(r[1] for r in rows)


def test_spread_of_far_apart_entities(spark):
    facts = [("a", d, 1e9 + d % 3) for d in range(1, 10)] + [("b", d, -1e9 + d % 3) for d in range(1, 10)]
    facts = spark.createDataFrame(facts, "e string, d int, v double").withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, d)"))
    spine = spark.sql("select * from values ('a', timestamp '2024-01-11'), ('b', timestamp '2024-01-11') as t(e, at)")
    for days, want in ((30, [d % 3 for d in range(1, 10)]), (4, [d % 3 for d in range(6, 10)]), (None, [d % 3 for d in range(1, 10)])):
        got = pit.window_features(spine, facts, "e", "at", "ts", days, {"s": ("std", F.col("v"))}).collect()
        assert [r.s for r in got] == [pytest.approx(statistics.stdev(want))] * 2


def test_spread_of_a_far_slice(spark):
    rows = [("far", 0.0, 1e9 + i % 3) for i in range(60)] + [("near", 0.0, float(i % 5)) for i in range(60)] + [("mid", 0.0, float(i % 4)) for i in range(50)]
    df = spark.createDataFrame(rows, "s string, y double, p double")
    got = {r.value: r for r in errors.slice_errors(df, "y", "p", ["s"], "mae").collect()}
    far = got["far"]
    # the rest is near 0, so Welch's degrees of freedom come from both spreads: exact for the far slice itself
    v1, v2 = statistics.variance([i % 3 for i in range(60)]) / 60, statistics.variance([i % 5 for i in range(60)] + [i % 4 for i in range(50)]) / 110
    assert far.rate == pytest.approx(1e9 + 1) and far.rest_rate == pytest.approx(statistics.mean([i % 5 for i in range(60)] + [i % 4 for i in range(50)]), abs=1e-5)
    near = spark.createDataFrame([r for r in rows if r[0] != "far"], "s string, y double, p double")
    one = {r.value: r for r in errors.slice_errors(near, "y", "p", ["s"], "mae").collect()}["near"]
    a, b = [i % 5 for i in range(60)], [i % 4 for i in range(50)]
    want = (statistics.mean(a) - statistics.mean(b)) / (statistics.variance(a) / 60 + statistics.variance(b) / 50) ** 0.5
    assert one.stat == pytest.approx(want) and v1 > 0 and v2 > 0


def test_every_feature_is_shuffled_along_an_order_of_its_own(spark):
    """The distance between a row and where its value goes is not one number for all rows, as it is in a rotation of one order."""
    df = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("u"), F.col("id").alias("v"))
    seen = []
    explain.permutation_importance(df, ["k"], ["u", "v"], lambda d: d, lambda d: (seen.append(d), d.agg(F.sum("u").alias("value")))[1])
    order = {name: [r.k for r in df.orderBy(F.expr(f"conv(substring(md5(concat('7:{name}', k)), 1, 8), 16, 10)").cast("bigint") % (2**31 - 1), "k").collect()]
             for name in ("home", "u", "v")}
    for f, d in zip(("u", "v"), seen[1:]):
        assert {r.k: r[f] for r in d.select("k", f).collect()} == dict(zip(order["home"], order[f]))
