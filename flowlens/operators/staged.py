"""A boosted model judged after every round: one fit, and the best prefix of its trees by validation.

The margins after 1, 2, … rounds are running sums of the trees' weighted predictions, so no model is fitted or applied
again. The trees are read from the model's own saved form, one row for each node, and sent to the tasks; they are as large as the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.session import saved, scratch_path


class Tree:
    """Nodes as arrays; ``apply`` walks all rows down together."""

    def __init__(self, nodes: list):
        nodes = sorted(nodes, key=lambda n: n["id"])
        self.feature = np.array([n["split"]["featureIndex"] for n in nodes])
        self.left, self.right = (np.array([n[side] for n in nodes]) for side in ("leftChild", "rightChild"))
        self.value = np.array([n["prediction"] for n in nodes])
        self.ordered = np.array([n["split"]["numCategories"] < 0 for n in nodes])
        self.threshold = np.array([n["split"]["leftCategoriesOrThreshold"][0] if o and n["leftChild"] >= 0 else 0.0
                                   for n, o in zip(nodes, self.ordered)])
        self.categories = {i: np.array(n["split"]["leftCategoriesOrThreshold"]) for i, n in enumerate(nodes)
                           if not self.ordered[i] and n["leftChild"] >= 0}

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            seen = x[inner, self.feature[node]]
            left = seen <= self.threshold[node]
            for i, few in self.categories.items():
                here = node == i
                left[here] = np.isin(seen[here], few)
            at[inner] = np.where(left, self.left[node], self.right[node])


def trees_of(spark: SparkSession, model: GBTClassificationModel) -> list[Tree]:
    path = scratch_path(spark, "boosted")
    model.write().save(path)
    nodes: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], []).append(row["nodeData"])
    return [Tree(nodes[i]) for i in sorted(nodes)]


def staged_margins(model: GBTClassificationModel, rows: DataFrame, label: str = "y_true") -> DataFrame:
    """``round, margin, y_true, n``: how many rows of a label have a margin after a round; equal ones are counted within
    a batch. ``rows`` has the ``features`` that the model was fitted on."""
    shared = rows.sparkSession.sparkContext.broadcast((trees_of(rows.sparkSession, model), list(model.treeWeights)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, weights = shared.value
        for frame in frames:
            x = np.stack(list(frame["features"])) if len(frame) else np.empty((0, 0))
            truth, margin = frame["label"].to_numpy(), np.zeros(len(frame))
            for i, (tree, weight) in enumerate(zip(trees, weights), 1):
                margin = margin + weight * tree.apply(x)
                yield (pd.DataFrame({"round": i, "margin": margin, "y_true": truth})
                       .groupby(["round", "margin", "y_true"], as_index=False).size().rename(columns={"size": "n"}))

    slim = rows.select(vector_to_array("features").alias("features"), F.col(label).cast("int").alias("label"))
    return slim.mapInPandas(run, "round int, margin double, y_true int, n long")


def staged_validation(model: GBTClassificationModel, rows: DataFrame, label: str = "y_true") -> DataFrame:
    """``round, pr_auc``: average precision on ``rows`` after every round."""
    counts = saved(staged_margins(model, rows, label).where("y_true is not null")
                   .groupBy("round", "margin", "y_true").agg(F.sum("n").alias("n")))
    curve = M.score_curve(counts, ["round"], score="margin", weight="n")
    return curve.groupBy("round").agg(M.average_precision().alias("pr_auc"))


def prefix(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model that has only the first ``rounds`` trees."""
    if not 1 <= rounds <= len(model.treeWeights):
        raise ValueError(f"rounds must be 1 to {len(model.treeWeights)}, not {rounds}")
    gateway = SparkSession.active().sparkContext._gateway
    package = gateway.jvm.org.apache.spark.ml
    trees = gateway.new_array(package.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    own = model._java_obj.trees()
    for i, weight in enumerate(list(model.treeWeights)[:rounds]):
        trees[i], weights[i] = own[i], weight
    short = GBTClassificationModel(package.classification.GBTClassificationModel(model.uid, trees, weights))
    short._resetUid(model.uid)
    return model._copyValues(short)


def best_prefix(model: GBTClassificationModel, rows: DataFrame, label: str = "y_true") -> tuple[int, GBTClassificationModel, DataFrame]:
    """The round with the best validation average precision (the earliest among equals), the model up to it and the
    table ``round, pr_auc``, of which one row comes to the driver."""
    table = saved(staged_validation(model, rows, label))
    best = table.orderBy(F.col("pr_auc").desc(), "round").first()
    if best is None:
        raise ValueError("no labelled rows to validate on")
    return best["round"], prefix(model, best["round"]), table
