"""Boosted trees fitted from counts of equal rows inside one task, all rounds one after the other.

The method is that of Spark's boosted trees: regression trees on the slope of the logistic loss of labels -1 and 1, split where the variance
falls most, each leaf the mean of its rows; the first tree counts whole, later ones by the step size. A round needs the margins of the one
before, so rounds can't run side by side; as Spark jobs each costs one for every level, however few rows there are. Rows with the same bins
and label are one cell with a count, and while there are no more than ENTRIES cells times features, every round over them is a matter of
milliseconds in one process. How many cells there are is counted first; beyond the bound the caller fits with jobs.

A round draws rows without replacement: of a cell of n rows as many as a binomial draw of n says. Cells stand in an order that follows from
their values, and a round's draws from the seed and the round, so neither partitions nor cores show in the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells times features that one task takes.
ENTRIES = 1 << 23
#: A split must gain more than this share of a node's mean square; less is rounding.
LEAST_GAIN = 1e-10
COLUMNS = ["treeID", "id", "prediction", "impurity", "count", "sum", "square", "gain", "leftChild", "rightChild", "featureIndex", "threshold"]
TYPES = "treeID int, id int, prediction double, impurity double, count double, sum double, square double, gain double, leftChild int, " \
        "rightChild int, featureIndex int, threshold double"


class Rounds:
    """Cells (bins by feature, label 0 or 1, number of rows) and the margins that the trees so far give them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, edges: list[np.ndarray], depth: int, min_rows: int, min_gain: float):
        order = np.lexsort((y, *x.T))
        self.columns = [np.ascontiguousarray(c) for c in x[order].T]
        self.sign, self.n, self.edges = 2.0 * y[order] - 1, n[order], edges
        self.depth, self.min_rows, self.min_gain = depth, max(min_rows, 1), min_gain
        self.margin = np.zeros(len(n))

    def run(self, rounds: int, rate: float, share: float, seed: int) -> Iterator[np.ndarray]:
        """The nodes of each tree, rows of COLUMNS."""
        for i in range(rounds):
            slope = self.sign if i == 0 else 4 * self.sign / (1 + np.exp(np.minimum(2 * self.sign * self.margin, 700)))
            drawn = np.random.default_rng([seed % 2**63, i]).binomial(self.n, share) if share < 1 else self.n
            nodes = self.tree(slope, drawn.astype(float))
            self.margin += (1.0 if i == 0 else rate) * self.apply(nodes)
            yield np.column_stack([np.full(len(nodes), i), nodes])

    def tree(self, slope: np.ndarray, weight: np.ndarray) -> np.ndarray:
        rows = np.flatnonzero(weight)
        g, w = slope[rows], weight[rows]
        nodes = [self.node(0, w.sum(), (w * g).sum(), (w * g * g).sum())]
        open_, own = [0], np.zeros(len(rows), np.int64)  # own: a row's place among the open nodes
        for _ in range(self.depth):
            if not open_ or not len(rows):
                break
            best = self.best_splits(rows, own, len(open_), w, w * g)
            square = np.bincount(own, w * g * g, len(open_))
            following, feature = [], np.full(len(open_), -1)
            cut, child = np.zeros(len(open_), np.int64), np.full((len(open_), 2), -1)
            for at, (node, (gain, f, c)) in enumerate(zip(open_, best)):
                count = nodes[node][3]
                if gain / count >= self.min_gain and gain > LEAST_GAIN * square[at]:
                    feature[at], cut[at] = f, c
                    nodes[node][6:11] = gain / count, len(nodes), len(nodes) + 1, f, self.edges[f][c]
                    child[at] = len(following), len(following) + 1
                    following += [len(nodes), len(nodes) + 1]
                    nodes += [None, None]
            kept = np.flatnonzero(feature[own] >= 0)
            rows, own, g, w = rows[kept], own[kept], g[kept], w[kept]
            right = np.zeros(len(rows), np.int64)
            for f in np.unique(feature[feature >= 0]):
                here = np.flatnonzero(feature[own] == f)
                right[here] = self.columns[f][rows[here]] > cut[own[here]]
            own = child[own, right]
            sums = [np.bincount(own, v, len(following)) for v in (w, w * g, w * g * g)]
            for place, node in enumerate(following):
                nodes[node] = self.node(node, *(s[place] for s in sums))
            # A node whose rows have one slope is settled.
            left = np.array([nodes[node][2] > LEAST_GAIN * nodes[node][5] / nodes[node][3] for node in following], bool)
            again = np.cumsum(left) - 1
            kept = np.flatnonzero(left[own]) if len(left) else np.empty(0, np.int64)
            rows, own, g, w = rows[kept], again[own[kept]], g[kept], w[kept]
            open_ = [node for node, stays in zip(following, left) if stays]
        return np.array(nodes, float)

    @staticmethod
    def node(number: int, count: float, total: float, square: float) -> list:
        mean = total / count if count else 0.0
        return [number, mean, max(square / count - mean * mean, 0.0) if count else 0.0, count, total, square, -1.0, -1, -1, -1, 0.0]

    def best_splits(self, rows: np.ndarray, own: np.ndarray, count: int, w: np.ndarray, wg: np.ndarray) -> list[tuple[float, int, int]]:
        """Of each open node the fall of the sum of squares, the feature and the cut; the first of equal ones."""
        best, which, cuts = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            size = len(edges) + 1
            key = own * size + self.columns[f][rows]
            n = np.cumsum(np.bincount(key, w, count * size).reshape(count, size), 1)
            s = np.cumsum(np.bincount(key, wg, count * size).reshape(count, size), 1)
            n_left, s_left, n_all, s_all = n[:, :-1], s[:, :-1], n[:, -1:], s[:, -1:]
            n_right, s_right = n_all - n_left, s_all - s_left
            ok = (n_left >= self.min_rows) & (n_right >= self.min_rows)
            gains = s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1) - s_all**2 / np.maximum(n_all, 1)
            gains = np.where(ok, gains, -1.0)
            at = gains.argmax(1)
            gain = gains[np.arange(count), at]
            more = gain > best
            best[more], which[more], cuts[more] = gain[more], f, at[more]
        return list(zip(best.tolist(), which.tolist(), cuts.tolist()))

    def apply(self, nodes: np.ndarray) -> np.ndarray:
        """What a tree says of every cell, drawn or not."""
        left, right, feature = (nodes[:, i].astype(np.int64) for i in (7, 8, 9))
        cut = np.array([np.searchsorted(self.edges[f], t, "left") if f >= 0 else 0 for f, t in zip(feature, nodes[:, 10])])
        at, inner = np.zeros(len(self.n), np.int64), np.arange(len(self.n) if left[0] >= 0 else 0)
        while len(inner):
            now = at[inner]
            goes = np.zeros(len(inner), bool)
            for f in np.unique(feature[now]):
                here = np.flatnonzero(feature[now] == f)
                goes[here] = self.columns[f][inner[here]] > cut[now[here]]
            at[inner] = np.where(goes, right[now], left[now])
            inner = inner[left[at[inner]] >= 0]
        return nodes[at, 1]


def grown(blocks: DataFrame, edges: list[np.ndarray], rounds: int, depth: int, rate: float, share: float, min_rows: int, min_gain: float,
          seed: int) -> DataFrame:
    """The nodes of all trees. ``blocks``: x, y and n of cells as arrays in bytes, as ``forest.blocks_of`` makes them."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [r for f in frames for r in zip(f["x"], f["y"], f["n"])]
        y, n = (np.concatenate([np.frombuffer(r[i], kind) for r in held]) for i, kind in ((1, np.int32), (2, np.int64)))
        x = np.concatenate([np.frombuffer(r[0], np.int16).reshape(-1, len(edges)) for r in held])
        for nodes in Rounds(x, y, n, edges, depth, min_rows, min_gain).run(rounds, rate, share, seed):
            yield pd.DataFrame(nodes, columns=COLUMNS)

    return blocks.select("x", "y", "n").repartition(1).mapInPandas(run, TYPES)


def write_trees(nodes: DataFrame, rounds: int, rate: float, path: str, again: str) -> None:
    """At ``again`` the saved boosted model at ``path``, which may have any trees, with ``nodes`` for its trees."""
    spark = nodes.sparkSession
    split = F.struct("featureIndex", F.when(F.col("featureIndex") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
                     .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    nodes.select("treeID", F.struct("id", "prediction", "impurity", F.array("count", "sum", "square").alias("impurityStats"),
                                    F.col("count").cast("long").alias("rawCount"), "gain", "leftChild", "rightChild", split.alias("split"))
                 .alias("nodeData")).write.parquet(f"{again}/data")
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0]) | {"numTrees": rounds}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{again}/metadata")
    one = spark.read.parquet(f"{path}/treesMetadata").orderBy("_1").first()
    weights = [(i, one[1], 1.0 if i == 0 else float(rate)) for i in range(rounds)]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").write.parquet(f"{again}/treesMetadata")
