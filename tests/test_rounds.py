"""Boosted trees in one task against Spark's own, and the rounds of the registered query."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlens.operators import models as ML
from flowlens.operators import rounds
from flowlens.operators.cells import Boosted, BoostedInTask
from flowlens.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    # Odd factors, so that no two splits gain alike.
    few = spark.range(500).select(
        (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7 / 4).alias("b"), (F.col("id") % 3).cast("double").alias("c"),
        ((F.col("id") * 37 % 101 + 3 * (F.col("id") % 13) + 11 * (F.col("id") % 7)) > 90).cast("int").alias("y_true"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(few).cache()


def scores(model, rows):
    return [r.s for r in model.transform(rows).orderBy("a", "b", "c", "y_true").selectExpr("probability as s").collect()]


@pytest.mark.parametrize("least", [1, 5])
def test_trees_are_those_of_spark(spark, rows, least, monkeypatch):
    options = {"labelCol": "y_true", "maxIter": 12, "maxDepth": 4, "stepSize": 0.3, "seed": 3, "minInstancesPerNode": least}
    wanted = GBTClassifier(**options).fit(rows)
    monkeypatch.setattr(Boosted, "_fit", None)
    found = BoostedInTask(**options).fit(rows)
    assert isinstance(found, GBTClassificationModel) and found.treeWeights == wanted.treeWeights and found.numFeatures == 3
    assert np.allclose(scores(found, rows), scores(wanted, rows), atol=1e-9)
    assert [t.numNodes for t in found.trees] == [t.numNodes for t in wanted.trees]


def test_rounds_draw_rows_not_cells(rows):
    """A cell of many rows is neither in nor out as a whole, and each round draws anew; the same seed draws the same."""
    x, y, n = np.array([[0], [0], [1]], np.int16), np.array([0, 1, 1]), np.array([1000, 3000, 2000])
    runs = [[t[0, 4] for t in rounds.Rounds(x, y, n, [np.array([0.5])], 2, 1, 0.0).run(20, 0.1, 0.8, seed)] for seed in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2] and len(set(runs[0])) > 10
    assert all(4600 < count < 5000 for count in runs[0])


def test_many_cells_are_fitted_by_jobs(rows, monkeypatch):
    options = {"labelCol": "y_true", "maxIter": 2, "maxDepth": 3, "seed": 3}
    wanted = scores(GBTClassifier(**options).fit(rows), rows)
    monkeypatch.setattr(rounds, "ENTRIES", 10)
    monkeypatch.setattr(rounds, "grown", None)
    assert np.allclose(scores(BoostedInTask(**options).fit(rows), rows), wanted)


def test_query_has_the_rounds_of_the_reference(spark, monkeypatch):
    made = []
    build = ML.boosted
    monkeypatch.setattr(ML, "boosted", lambda *a, **k: made.append(build(*a, **k)) or made[-1])
    out = catalog.QUERIES["ml_3_boosted"](spark, SMALL)
    assert out.where("y_true <> y_pred").count() == 0 < out.count()
    assert [(b.getMaxIter(), b.getMaxDepth(), b.getStepSize(), b.getSubsamplingRate()) for b in made] == [(600, 6, 0.05, 0.8)]
