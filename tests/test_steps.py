"""Isotonic steps against the min-max formula, and shared attributes against brute force."""
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmground.operators import calibrate, pit
from firmground.streaming import streams


def plain_isotonic(rows):
    scores = sorted({p for p, _ in rows})
    pos = np.array([sum(y for p, y in rows if p == s) for s in scores], float)
    n = np.array([sum(1 for p, _ in rows if p == s) for s in scores], float)
    share = lambda j, k: pos[j:k + 1].sum() / n[j:k + 1].sum()
    return scores, [max(min(share(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i in range(len(scores))]


@pytest.mark.parametrize("kind", ["noisy", "falling", "rising"])
def test_isotonic_in_small_chunks(spark, monkeypatch, kind):
    monkeypatch.setattr(calibrate, "MIN_POSITIVES", 1)
    rng = random.Random(3)
    chance = {"noisy": lambda p: p, "falling": lambda p: 1 - p, "rising": lambda p: float(p > 0.4)}[kind]
    rows = [(round(p, 2), int(rng.random() < chance(p))) for p in (rng.random() for _ in range(900))]
    scores, fit = plain_isotonic(rows)
    df = spark.createDataFrame(rows, "p double, y int").repartition(4)
    asked = [-1.0, 2.0, 0.555, None, float("nan"), *scores, *(s + 0.004 for s in scores)]
    for size in (2, 7, 20_000):
        model = calibrate.isotonic_fit(df, "y", "p", size)
        got = {r.p: r.c for r in model.apply(spark.createDataFrame([(a, 1) for a in asked], "p double, low int"), "p", "c").collect() if r.p == r.p}
        assert got.pop(None) is None
        for p, c in got.items():
            assert c == pytest.approx(np.interp(p, scores, fit), abs=1e-9)
    steps = model.steps.orderBy("low").collect()
    assert all(a.value <= b.value and a.high < b.low and a.next_low == b.low for a, b in zip(steps, steps[1:]))


def test_shared_values_with_hubs(spark):
    rng = random.Random(4)
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=d)
    edges = [(rng.choice([*range(30), None]), day(rng.randrange(200)), rng.choice([None, *range(25)]), rng.choice("abcdefghijkl"), int(rng.random() < 0.02)) for _ in range(600)]
    spine = [(u, day(d)) for u in (*range(30), 99) for d in (0, 40, 90, 150, 300)]
    e = spark.createDataFrame(edges, "u int, ts timestamp, device int, city string, bad int").repartition(3)
    s = spark.createDataFrame(spine, "u int, d timestamp")
    for hub in (1, 3, 8, 100):
        got = {(r.u, r.d): (r.shared_with, r.neighbour_rate) for r in pit.sharing_union(s, e, "u", "d", "ts", ["device", "city"], hub, "bad").collect()}
        assert len(got) == len(spine)
        for u, d in spine:
            near = set()
            for a in (2, 3):
                for v in {x[a] for x in edges if x[0] == u and x[1] < d and x[a] is not None}:
                    users = {x[0] for x in edges if x[a] == v and x[1] < d and x[0] is not None}
                    near |= users if len(users) <= hub else set()
            near.discard(u)
            bad = sum(any(x[0] == o and x[1] < d and x[4] for x in edges) for o in near)
            assert got[u, d][0] == len(near), (u, d, hub)
            assert got[u, d][1] == (pytest.approx(bad / len(near)) if near else None)
    assert pit.sharing_union(s, e.limit(0), "u", "d", "ts", ["device"], 5).where("shared_with = 0").count() == len(spine)
    assert "neighbour_rate" not in pit.sharing_union(s, e, "u", "d", "ts", ["device"], 5).columns


def test_screen_makes_its_frame_once(spark):
    from firmground.operators import funnel

    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"), F.udf(seen, "long")(F.col("id") % 7).alias("a"),
                                 F.concat(F.lit("t"), F.col("id") % 3).alias("b"))
    trail = funnel.run(df, "y", ["a", "b"], ["id"]).collect()
    assert {(r.stage, r.feature) for r in trail} == {(k, c) for k in range(6) for c in "ab"}
    assert made.value == 300


def test_streaming_sessions_carry_only_what_is_open(spark, tmp_path):
    """Against Spark's own session window over the same deliveries: late rows, rows without a user or time."""
    at = lambda hours: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)
    rows = [(0, u, at(h + u / 60)) for u in range(40) for h in (0, 1, 3.25, 5.5, 20, 21.9)] + [(0, 50, at(22)), (0, 60, at(1)), (0, None, at(2)), (0, 3, None)]
    rows += [(1, 1, at(22.5)), (1, 50, at(23.9)), (1, 60, at(2)), (1, 60, at(21)), (1, None, at(23)), (1, 2, at(19.5)), (1, 70, at(30))]
    rows += [(2, 70, at(31)), (2, 50, at(20)), (2, 71, at(28.5)), (2, 1, at(60))]
    arrivals = spark.createDataFrame(rows, "k int, user_id long, ts timestamp")
    take = lambda df: sorted(((r.user_id, r.start, r.end, r.n) for r in df.collect()), key=repr)
    want = streams.run_restarted(arrivals, "k", 3, lambda s: streams.sessions(s, "user_id", "ts", "2 hours", "2 hours"), "ts", f"{tmp_path}/spark")
    run = lambda s, table, state: streams.run_sessions(s, "user_id", "ts", "2 hours", "2 hours", table, state)
    got = streams.run_restarted(arrivals, "k", 3, lambda s: s, "ts", f"{tmp_path}/ours", run)
    assert take(got) == take(want) and len(take(got)) > 150
    carried = [spark.read.parquet(f"{tmp_path}/ours/table/batch={n}/open=true").count() for n in range(3)]
    assert carried[0] < 50 and carried[1:] == [1, 1]
    # as in the batch form, a gap of exactly two hours parts two sessions
    exact = spark.createDataFrame([(0, 1, at(0)), (1, 1, at(2)), (1, 1, at(3)), (2, 2, at(40))], arrivals.schema)
    assert take(streams.run_restarted(exact, "k", 3, lambda s: s, "ts", f"{tmp_path}/exact", run)) == [(1, at(0), at(2), 1), (1, at(2), at(5), 2)]
    empty = streams.run_restarted(arrivals.limit(0), "k", 2, lambda s: s, "ts", f"{tmp_path}/none", run)
    assert take(empty) == [] and empty.columns == ["user_id", "start", "end", "n"]
