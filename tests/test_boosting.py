"""Trees on counted cells against Spark's trees on rows, and the size of what they are grown over."""
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from firmground.functions.boosting import BINS, Boosted, split_points
from firmground.operators import baselines as B, metrics as M


def frame(spark, n):
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000))
    return spark.range(n).select((h(1) % 20).cast("double").alias("a"), (h(2) % 7).cast("double").alias("b"), h(3).cast("double").alias("c"),
                                 ((h(1) % 20) * 40 + h(4) > 1000).cast("int").alias("y"))


def test_counted_cells_give_the_trees_of_all_rows(spark):
    df = frame(spark, 3000)
    grown = Boosted(df, ["a", "b"], "y")
    model = grown.fit(4, 7)
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="v")
    plain = GBTClassifier(featuresCol="v", labelCol="y", maxIter=4, maxDepth=3, stepSize=0.1, seed=7).fit(vec.transform(df))
    assert abs(model.featureImportances.toArray() - plain.featureImportances.toArray()).max() < 1e-9
    p = lambda x, y: sorted((r[0], round(r[1], 9)) for r in x.select(F.col(y).cast("int"), vector_to_array("probability")[1]).collect())
    assert p(grown.score(model, df, "y"), "_label") == p(plain.transform(vec.transform(df)), "y")


def test_fits_read_no_more_cells_for_more_rows(spark):
    cells = Boosted(frame(spark, 60_000), ["a", "b"], "y").cells
    assert cells.count() <= 20 * 7 * 2 and cells.agg(F.sum("_weight")).first()[0] == 60_000


def test_no_feature_has_more_bins_than_a_tree_sees(spark):
    grown = Boosted(frame(spark, 20_000), ["a", "c"], "y")
    assert len(grown.cuts["a"]) == 19 and len(grown.cuts["c"]) == BINS - 1
    assert grown.cells.count() <= 20 * BINS * 2
    assert split_points([(1.0, 1.0, 5), (3.0, 3.0, 1)]) == [2.0] and split_points([(1.0, 1.0, 5)]) == []


def test_counted_scores_rank_like_rows(spark):
    df = frame(spark, 4000)
    rows = M.ranking(B.boosted(df, df, "y", ["a", "c"], trees=3), "_label", "_p").first()
    cells = M.ranking(B.boosted(df, df, "y", ["a", "c"], trees=3, counted=True), "_label", "_p", weight="_weight").first()
    assert rows["n"] == cells["n"] == 4000 and abs(rows["auc"] - cells["auc"]) < 1e-12 and abs(rows["ap"] - cells["ap"]) < 1e-12
