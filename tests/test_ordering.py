"""Chunked ordering against brute force in pandas, with ties, hot keys and different partition counts."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from firmground.functions import ordering as O


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "t": rng.integers(0, 500, n), "id": np.arange(n), "v": rng.normal(size=n).round(3)})
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5), pdf


@pytest.mark.parametrize("chunks", [1, 3, 17])
def test_running_sum_equals_cumsum(spark, frame, chunks):
    df, pdf = frame
    counts = df.groupBy("t").agg(F.count("*").alias("n"))
    got = O.running(counts, ["t"], {"upto": ("sum", "n")}, bounds=O.chunk_bounds(counts, ["t"], chunks)[0]).toPandas()
    want = pdf.groupby("t").size().cumsum()
    assert got.set_index("t")["upto"].sort_index().tolist() == want.tolist()


def test_running_by_group_descending_min(spark, frame):
    df, pdf = frame
    got = O.running(df, ["t", "id"], {"m": ("min", "v")}, ["k"], descending=True, inclusive=False).toPandas()
    want = pdf.sort_values(["t", "id"], ascending=False)
    want["m"] = want.groupby("k")["v"].transform(lambda s: s.cummin().shift())
    both = got.merge(want, on="id")
    assert np.array_equal(both["m_x"].to_numpy(), both["m_y"].to_numpy(), equal_nan=True)


def test_hot_keys_are_split_and_equal_plain_windows(hot, frame):
    df, _ = frame
    assert O.with_group_chunk(df, "k", "t").where("k = 0").select(O.CHUNK).distinct().count() > 10

    def stats(d, part):
        w = Window.partitionBy(*part).orderBy("t", "id")
        return d.withColumns({"lagged": F.lag("v", 3).over(w), "next": F.lead("v").over(w),
                              "roll": F.round(F.sum("v").over(w.rowsBetween(-4, -1)), 6)})

    want = stats(df, ["k"]).select("id", "lagged", "next", "roll").toPandas().sort_values("id").reset_index(drop=True)
    got = O.framed(df, "k", ["t", "id"], stats, back=4, ahead=1, block=37).select("id", "lagged", "next", "roll").toPandas()
    pd.testing.assert_frame_equal(got.sort_values("id").reset_index(drop=True), want)


def test_grouped_running_hot_equals_plain(hot, frame):
    df, _ = frame
    split = O.grouped_running(df, "k", ["k"], ["t", "id"], {"s": ("sum", "id"), "m": ("max", "v")}).select("id", "s", "m").toPandas().sort_values("id")
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = df.select("id", F.sum("id").over(w).alias("s"), F.max("v").over(w).alias("m")).toPandas().sort_values("id")
    pd.testing.assert_frame_equal(split.reset_index(drop=True), plain.reset_index(drop=True))


def test_null_groups_carry_over_chunks(hot, frame):
    df, pdf = frame
    holed = df.withColumn("k", F.when(F.col("k") % 3 > 0, F.col("k")))
    got = O.running(holed, ["t", "id"], {"s": ("sum", "id")}, ["k"]).where("k is null").toPandas().sort_values(["t", "id"])
    want = pdf[pdf.k % 3 == 0].sort_values(["t", "id"])["id"].cumsum()
    assert got["s"].tolist() == want.tolist()


def test_quantiles_equal_numpy(spark, frame):
    df, pdf = frame
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = O.quantiles(df, ["v", "t"], probs, ["k"]).toPandas()
    for _, r in got.iterrows():
        want = np.quantile(pdf.loc[pdf.k == r.k, r.column], probs)
        assert np.allclose([r[f"q{i}"] for i in range(5)], want)


@pytest.mark.parametrize("parts", [1, 6])
def test_order_cuts_with_ties(spark, frame, parts):
    df, pdf = frame
    cuts = O.order_cuts(df.repartition(parts).select("t", "id"), ["t", "id"], lambda n: [0, n // 3, n - 1, n])
    line = pdf.sort_values(["t", "id"])[["t", "id"]].to_numpy()
    assert [c[0] for c in cuts[1:3]] == [tuple(line[i]) for i in (len(line) // 3, len(line) - 1)]
    assert cuts[0] == ((), 0) or cuts[0][0][0] == line[0][0]
    assert all(c[1] == 0 for c in cuts[:3])
    assert cuts[3] is None


def test_one_timestamp_with_most_rows_is_cut_by_the_key(spark):
    n = 2000
    pdf = pd.DataFrame({"t": np.where(np.arange(n) % 3 == 0, np.arange(n) % 7, 3), "id": np.random.default_rng(1).permutation(n)})
    df = O.with_order_chunk(spark.createDataFrame(pdf), ["t", "id"], 8)
    sizes = df.groupBy(O.CHUNK).count().toPandas()["count"]
    assert sizes.max() < n / 4
    line = df.toPandas().sort_values(["t", "id"])
    assert line[O.CHUNK].is_monotonic_increasing
    got = O.running(spark.createDataFrame(pdf).withColumn("one", F.lit(1)), ["t", "id"], {"rn": ("sum", "one")}).toPandas()
    assert got.sort_values(["t", "id"])["rn"].tolist() == list(range(1, n + 1))


def test_blocks_of_cut_keys_in_both_directions(hot, frame):
    df, pdf = frame
    rows = df.withColumn("b", F.floor(F.col("t") / 100))
    chunked, cut = O.group_chunks(rows, "k", "t", "c", judged_by=df)
    assert cut is not None and chunked.where(cut).select("k").distinct().count() < 40
    # the condition names exactly the keys that lie in several chunks
    inside = chunked.where(~cut).groupBy("k").agg(F.count_distinct("c").alias("n")).where("n > 1")
    assert inside.count() == 0
    pdf = pdf.assign(b=pdf.t // 100)
    for down in (False, True):
        got = O.grouped_running(chunked, "k", ["k", "b"], ["t", "id"], {"s": ("sum", "id"), "m": ("min", "v")}, descending=down,
                                inclusive=False, chunk_col="c", cut=cut).toPandas().sort_values("id")
        line = pdf.sort_values(["t", "id"], ascending=not down)
        sums = line.groupby(["k", "b"])["id"].cumsum() - line["id"]
        mins = line.groupby(["k", "b"])["v"].transform(lambda s: s.cummin().shift())
        first = line.groupby(["k", "b"]).cumcount() == 0
        assert np.array_equal(got["s"].to_numpy(float), sums.where(~first).sort_index().to_numpy(), equal_nan=True)
        assert np.array_equal(got["m"].to_numpy(), mins.sort_index().to_numpy(), equal_nan=True)


def test_even_keys_need_one_shuffle_and_no_join(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("k"), F.col("id").alias("t"))
    assert O.group_chunks(df, "k", "t")[1] is None
    got = O.framed(df, "k", ["t"], lambda d, part: d.withColumn("p", F.lag("t").over(Window.partitionBy(*part).orderBy("t"))), back=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert got.where("p is null and t >= 400 or p <> t - 400").count() == 0


def test_a_key_whose_times_are_all_null_is_one_piece(hot):
    df = hot.range(500).select(F.lit(1).alias("k"), F.lit(None).cast("double").alias("t"), "id")
    got = O.grouped_running(df, "k", ["k"], ["t", "id"], {"s": ("sum", "id")}).toPandas().sort_values("id")
    assert got["s"].tolist() == got["id"].cumsum().tolist()


def test_each_of_many_large_keys_gets_cuts_for_its_own_size(spark):
    pdf = pd.DataFrame({"k": np.r_[np.zeros(4000), np.repeat(np.arange(1, 21), 200)], "t": np.arange(8000)})
    chunked, heavy = O.order_chunks(spark.createDataFrame(pdf), ["k", "t"], 60)
    pieces = chunked.groupBy("k").agg(F.count_distinct(O.CHUNK).alias("n")).toPandas().set_index("k")["n"]
    assert pieces[0] >= 30 and pieces.drop(0).max() <= 8 and set(pieces[pieces > 1].index) <= set(heavy)
