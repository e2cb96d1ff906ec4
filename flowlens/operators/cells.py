"""Classifiers fitted from distinct rows with counts: the loss is a sum over rows, so equal rows are one row with a weight.

The fitted model is Spark's own. Where few rows are equal, the work is that of the rows and one shuffle of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
                                       MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import rounds
from flowlens.operators.forest import blocks_of, find_edges
from flowlens.session import saved, scratch_path

#: As how many rows of a share of its weight a distinct row stands at most, where each round of boosting draws rows.
PIECES = 16


class Logistic(LogisticRegression):
    """Spark's logistic regression on distinct rows; weights of rows add up."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(vector_to_array(features).alias("__x"), F.col(label).alias(label), weight.alias("__w"))
        cells = saved(rows.groupBy("__x", label).agg(F.sum("__w").alias("__w")))
        few = cells.select(array_to_vector("__x").alias(features), label, "__w")
        model = super(Logistic, self.copy({self.weightCol: "__w"}))._fit(few)
        model.clear(model.weightCol)
        return self._copyValues(model)


class Boosted(GBTClassifier):
    """Spark's boosted trees on distinct rows, weighted by their number or by the sum of their weights.

    With a ``subsamplingRate`` below 1 a round draws what is left of equal rows in at most PIECES parts, each by itself. A leaf's least
    number of rows is kept as a weight; with weights of rows it can't be, so such a fit is over all rows.
    """

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        features, label, least = self.getFeaturesCol(), self.getLabelCol(), self.getMinInstancesPerNode()
        weighted, total = self.isDefined(self.weightCol), dataset.count() if least > 1 else 0
        if least > 1 and (weighted or 2 * least > total):
            return super()._fit(dataset)
        weight = F.col(self.getWeightCol()).cast("double") if weighted else F.lit(1.0)
        aside = [self.getValidationIndicatorCol()] if self.isDefined(self.validationIndicatorCol) else []
        rows = dataset.select(vector_to_array(features).alias("__x"), F.col(label).alias(label), *aside, weight.alias("__w"))
        cells = rows.groupBy("__x", label, *aside).agg(F.sum("__w").alias("__w"), F.count(F.lit(1)).alias("__n"))
        # What a round draws goes by the place of a row, so the places must be the same in each run.
        few = saved(cells.sortWithinPartitions("__x", label, *aside)).select(array_to_vector("__x").alias(features), label, *aside, "__w", "__n")
        if self.getSubsamplingRate() < 1:
            parts = F.least("__n", F.lit(PIECES)).cast("int")
            few = few.withColumn("__w", F.col("__w") / parts).withColumn("__n", F.explode(F.array_repeat(F.lit(0), parts)))
        changed = {self.weightCol: "__w"}
        if least > 1:  # a little less, as the share is multiplied by the sum of weights again
            changed |= {self.minInstancesPerNode: 1, self.minWeightFractionPerNode: max(self.getMinWeightFractionPerNode(), (least - 0.5) / total)}
        model = super(Boosted, self.copy(changed))._fit(few)
        for param in changed:
            model.clear(param)
        return self._copyValues(model)


class BoostedInTask(Boosted):
    """The same trees with all rounds in one task over counts of equal rows (``rounds``), where these are counted and few enough.

    A round draws rows, not parts of cells. With weights of rows, rows held aside or features left to chance, and beyond ``rounds.ENTRIES``, it
    is ``Boosted``.
    """

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        features, label = self.getFeaturesCol(), F.col(self.getLabelCol()).cast("double")
        if self.isDefined(self.weightCol) or self.isDefined(self.validationIndicatorCol) or self.getMinWeightFractionPerNode() \
                or self.getFeatureSubsetStrategy() != "all":
            return super()._fit(dataset)
        cells = saved(dataset.select(vector_to_array(features).alias("x"), label.alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
        odd = F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0) | F.exists("x", F.isnan)
        width, wrong = cells.agg(F.max(F.size("x")), F.max(odd)).first()
        if not width or wrong:
            return super()._fit(dataset)
        cells = cells.withColumn("y", F.col("y").cast("int"))
        edges = find_edges(cells, width, self.getMaxBins())
        blocks = blocks_of(cells, edges)
        if blocks.agg(F.sum(F.octet_length("y")) / 4).first()[0] * width > rounds.ENTRIES:
            return super()._fit(dataset)
        nodes = rounds.grown(blocks, edges, self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate(),
                             self.getMinInstancesPerNode(), self.getMinInfoGain(), self.getSeed())
        spark = dataset.sparkSession
        few = spark.createDataFrame([(Vectors.dense([0.0] * width), float(c)) for c in range(2)], [features, self.getLabelCol()])
        roots = GBTClassifier._fit(self.copy({self.maxIter: 1, self.maxDepth: 0, self.subsamplingRate: 1.0, self.minInstancesPerNode: 1}), few)
        path, again = (scratch_path(spark, name) for name in ("roots", "boosted"))
        roots.write().save(path)
        rounds.write_trees(nodes, self.getMaxIter(), self.getStepSize(), path, again)
        return self._copyValues(GBTClassificationModel.load(again))


class Perceptron(MultilayerPerceptronClassifier):
    """Spark's perceptron, its loss and slope summed by array products in the tasks, one pass for each step of L-BFGS on the driver.

    Only sums as large as the model come to the driver, one for each task. ``solver`` and ``blockSize`` have no effect.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        features, label, layers = self.getFeaturesCol(), self.getLabelCol(), list(self.getLayers())
        rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
        cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        blocks = saved(cells.repartition(dataset.sparkSession.sparkContext.defaultParallelism).mapInPandas(_pack, "x binary, y binary, n binary"))
        start = self.getInitialWeights().toArray() if self.isDefined(self.initialWeights) else random_weights(layers, self.getSeed())
        weights = minimise(lambda w: loss(blocks, layers, w), start, self.getMaxIter(), self.getTol())
        few = dataset.sparkSession.createDataFrame(
            [(Vectors.dense([0.0] * layers[0]), float(c)) for c in range(layers[-1])], [features, label])
        done = self.copy({self.initialWeights: Vectors.dense(weights), self.maxIter: 0, self.solver: "l-bfgs"})
        model = super(Perceptron, done)._fit(few)
        model.clear(model.initialWeights)
        return self._copyValues(model)


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            yield pd.DataFrame({"x": [np.stack(list(frame["x"])).astype(float).tobytes()], "y": [frame["y"].to_numpy(np.int32).tobytes()],
                                "n": [frame["n"].to_numpy(float).tobytes()]})


def random_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """As Spark draws them: evenly within 2.4 by the number of a layer's inputs."""
    rng = np.random.default_rng(seed % 2**63)
    return np.concatenate([rng.uniform(-2.4, 2.4, (a + 1) * b) / a for a, b in zip(layers, layers[1:])])


def _affine(layers: Sequence[int], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrices (inputs by outputs) and offsets, in the order in which Spark's model keeps them."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def slope(layers: Sequence[int], weights: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy of sigmoid layers under a softmax, summed over rows with counts, and its slope."""
    affine, outputs = _affine(layers, weights), [x]
    for i, (w, b) in enumerate(affine):
        z = outputs[-1] @ w + b
        outputs.append(1 / (1 + np.exp(-np.clip(z, -500, 500))) if i + 1 < len(affine) else z)
    z = outputs.pop()
    z -= z.max(1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(1, keepdims=True))
    total = -float(n @ logs[np.arange(len(y)), y])
    delta = np.exp(logs)
    delta[np.arange(len(y)), y] -= 1
    delta *= n[:, None]
    parts: list[np.ndarray] = []
    for (w, _), a in zip(reversed(affine), reversed(outputs)):
        parts = [(a.T @ delta).ravel(), delta.sum(0), *parts]
        if a is not x:
            delta = (delta @ w.T) * a * (1 - a)
    return total, np.concatenate(parts)


def loss(blocks: DataFrame, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy over all rows, and its slope."""
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows, sums = 0.0, 0.0, np.zeros(len(shared.value))
        for frame in frames:
            for x, y, n in zip(frame["x"], frame["y"], frame["n"]):
                labels, counts = np.frombuffer(y, np.int32), np.frombuffer(n)
                part, gradient = slope(layers, shared.value, np.frombuffer(x).reshape(len(labels), -1), labels, counts)
                total, rows, sums = total + part, rows + counts.sum(), sums + gradient
        yield pd.DataFrame({"total": [total], "rows": [rows], "sums": [sums.tobytes()]})

    found = blocks.mapInPandas(run, "total double, rows double, sums binary").collect()
    shared.unpersist()
    rows = sum(r["rows"] for r in found)
    if not rows:
        raise ValueError("no rows to fit on")
    return sum(r["total"] for r in found) / rows, sum(np.frombuffer(r["sums"]) for r in found) / rows


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """L-BFGS with a search along each direction; ends where the value falls by less than ``tolerance`` of itself or the slope vanishes."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(steps):
        d, kept = g.copy(), []
        for s, u, r in reversed(past):
            a = r * (s @ d)
            kept.append(a)
            d -= a * u
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, u, r), a in zip(past, reversed(kept)):
            d += (a - r * (u @ d)) * s
        downhill, low, high, size = -(g @ d), 0.0, np.inf, 1.0
        for _ in range(30):  # until the value falls enough (Armijo) and the slope flattens (Wolfe)
            ahead, its = f(w - size * d)
            if ahead > value + 1e-4 * size * downhill:
                high = size
            elif -(its @ d) < 0.9 * downhill:
                low = size
            else:
                break
            size = (low + high) / 2 if high < np.inf else 2 * low
        if not ahead < value:
            break
        s, u = -size * d, its - g
        if s @ u > 1e-12 * (u @ u):
            past = [*past, (s, u, 1 / (s @ u))][-memory:]
        fell, w, value, g = value - ahead, w - size * d, ahead, its
        if fell <= tolerance * max(abs(value), 1e-12) or np.linalg.norm(g) <= tolerance * 1e-2:
            break
    return w
