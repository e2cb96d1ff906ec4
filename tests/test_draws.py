"""What a tree of a forest draws, and that passes look at the rows of open nodes alone."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlens.operators import forest
from flowlens.operators.forest import Draws, Forest, on_the_way


def chunk(*sizes, rows=1):
    return [(b, np.zeros((size, 1), np.int16), np.zeros(size, np.int32), np.full(size, rows, np.int64)) for b, size in enumerate(sizes)]


@pytest.mark.parametrize("rate", [1.0, 0.5])
def test_single_rows_are_drawn_by_a_poisson_law(rate):
    draws = Draws(chunk(150_000, 50_000), np.ones(200_000, np.int64), 7, rate)
    rows, w = draws.of_tree(3)(np.arange(200_000))
    for k in range(1, 5):
        p = math.exp(-rate) * rate**k / math.factorial(k)
        assert abs((w == k).sum() - 200_000 * p) < 5 * math.sqrt(200_000 * p)
    some, again = draws.of_tree(3)(rows[10:500])
    assert (some == rows[10:500]).all() and (again == w[10:500]).all()
    assert (np.isin(draws.of_tree(4)(np.arange(200_000))[0], rows).mean() - len(rows) / 200_000) < 0.01


def test_a_block_is_drawn_alike_in_any_company():
    two, one = chunk(100, 300), chunk(100, 300)[1:]
    for rows in (1, 9):
        n = np.full(400, rows)
        two, one = chunk(100, 300, rows=rows), chunk(100, 300, rows=rows)[1:]
        (r, w), (s, v) = Draws(two, n, 7, 1.0).of_tree(2)(np.arange(100, 400)), Draws(one, n[100:], 7, 1.0).of_tree(2)(np.arange(300))
        assert (r - 100 == s).all() and (w == v).all() and abs(w.sum() - 300 * rows) < 6 * math.sqrt(300 * rows)
    assert Draws(two, n, 7, 0.0).of_tree(2)(np.arange(5))[1].tolist() == [9.0] * 5


def test_only_rows_of_open_nodes_are_drawn(spark, monkeypatch):
    """Of 4,000 rows that one cut settles but for 40, a level below draws those 40."""
    asked = spark.sparkContext.accumulator(0)
    rows = spark.range(4000).select((F.col("id") % 100).cast("double").alias("a"), (F.col("id") % 41).cast("double").alias("b"),
                                    F.when(F.col("id") % 100 == 7, (F.col("id") % 41 > 20).cast("int")).otherwise((F.col("id") % 100 > 7).cast("int")).alias("y_true"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)

    class Counted(Draws):
        def of_tree(self, tree):
            weight = super().of_tree(tree)
            return lambda cells: asked.add(len(cells)) or weight(cells)

    monkeypatch.setattr(forest, "Draws", Counted)
    made = Forest(labelCol="y_true", featureSubsetStrategy="all", numTrees=1, bootstrap=False, maxDepth=9, maxBins=128).fit(rows)
    assert made.transform(rows).where("prediction <> y_true").count() == 0
    assert 4000 < asked.value < 8000


def test_nodes_above_the_open_ones():
    left, right = np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1])
    assert on_the_way([4], left, right) == {0, 1, 4} and on_the_way([2], left, right) == {0, 2}
