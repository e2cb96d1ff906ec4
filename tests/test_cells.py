"""Classifiers fitted from counts of equal rows, against Spark's own fits of every row."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from flowlens.operators import cells as CE
from flowlens.operators import forest as FO
from flowlens.operators import models as ML


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 3000)
    return spark.createDataFrame([(i, int(c), float(round(v, 1)), float(b)) for i, (c, v, b) in
                                  enumerate(zip(y, rng.normal(1.2 * y), rng.integers(0, 4, 3000)))], "row_id long, y_true int, a double, b double").cache()


def test_logistic_on_cells_is_that_on_rows(spark, rows):
    two = rows.withColumn("y_true", (F.col("y_true") > 0).cast("int")).withColumn("w", F.col("b") + 1)
    for weight in (None, "w"):
        spark_own = LogisticRegression(featuresCol="features", labelCol="y_true", maxIter=100)
        a, b = (ML.fit(two, c, ["a", "b"]).stages[-1] for c in (ML.logistic(100, weight), spark_own.setWeightCol(weight) if weight else spark_own))
        assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), rel=1e-4) and a.intercept == pytest.approx(b.intercept, rel=1e-4)


def test_a_slope_is_that_of_the_loss_and_weights_lie_as_in_sparks_model(spark, rows):
    layers, rng = [2, 4, 3, 3], np.random.default_rng(1)
    w = CE.random_weights(layers, 3)
    x, y, n = rng.normal(size=(50, 2)), rng.integers(0, 3, 50), rng.integers(1, 9, 50).astype(float)
    _, g = CE.slope(layers, w, x, y, n)
    for i in range(0, len(w), 5):
        e = np.zeros(len(w))
        e[i] = 1e-6
        assert (CE.slope(layers, w + e, x, y, n)[0] - CE.slope(layers, w - e, x, y, n)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-3)
    made = ML.fit(rows, ML.perceptron(2, 3, (4, 3), 40), ["a", "b"])
    own = ML.fit(rows, MultilayerPerceptronClassifier(featuresCol="features", labelCol="y_true", layers=layers, maxIter=40, seed=7), ["a", "b"])
    right = [m.transform(rows).where("prediction = y_true").count() for m in (made, own)]
    assert right[0] > right[1] - 100


def test_a_forest_on_cells_is_as_good_as_that_on_rows(spark, rows):
    made = ML.fit(rows, ML.forest(30, 5), ["a", "b"]).stages[-1]
    own = ML.fit(rows, RandomForestClassifier(featuresCol="features", labelCol="y_true", numTrees=30, maxDepth=5, seed=7), ["a", "b"])
    right = [m.transform(own.stages[-2].transform(_before(own, rows))).where("prediction = y_true").count() for m in (made, own.stages[-1])]
    assert right[0] > right[1] - 60 and made.getNumTrees == 30 and made.getMaxDepth() == 5 and made.numClasses == 3


def _before(model, rows):
    for stage in model.stages[:-2]:
        rows = stage.transform(rows)
    return rows


def test_a_forest_without_bootstrap_and_subsets_splits_as_one_tree(spark):
    """All trees alike: the split of least impurity, whatever the partitions."""
    data = [(int(v > 37), float(v), float(v % 2)) for v in range(100) for _ in range(3)]
    frames = [spark.createDataFrame(data, "y_true int, a double, b double").repartition(p) for p in (1, 7)]
    for frame in frames:
        model = ML.fit(frame, ML.forest(3, 4, bootstrap=False, featureSubsetStrategy="all"), ["a", "b"], scaled=False).stages[-1]
        assert model.totalNumNodes == 9 and "<= 37.5" in model.toDebugString


def test_a_cut_between_any_two_of_many_values(spark):
    """150 values of three classes: 32 bins by rank would join values of two classes, and the border rows went wrong."""
    data = [(v // 50, float(v)) for v in range(150) for _ in range(1 + v % 3)]
    frame = spark.createDataFrame(data, "y_true int, a double")
    made = ML.classify(ML.fit(frame, ML.forest(20, 6), ["a"]), frame, ["y_true"])
    assert made.where("y_true <> y_pred").count() == 0


def test_a_forest_draws_alike_on_any_partitions(spark, rows):
    one, two = (ML.fit(rows.repartition(p), ML.forest(5, 4), ["a", "b"], scaled=False).stages[-1].toDebugString.split("\n", 1)[1] for p in (1, 9))
    assert one == two


def test_many_values_are_cut_at_quantiles(spark, monkeypatch):
    monkeypatch.setattr(FO, "VALUES", 10)
    cells = spark.createDataFrame([([float(v)], 0, 2) for v in range(100)], "x array<double>, y int, n long")
    edges = FO.find_edges(cells, 1, 20)[0]
    assert 15 <= len(edges) <= 19 and edges[0] < 10 and edges[-1] > 90
