"""Random forests fitted from counts of equal rows, all trees together, one pass for each level.

Rows with the same bins and label are one cell with a count. A row that is drawn with replacement has a Poisson(1) weight in each tree, so
a cell of n rows has a Poisson(n) weight: the trees are those of a bootstrap over rows, and the work of a level grows with the cells.
A pass sums the weights of the open nodes by feature, bin and label in the tasks; a group for each tree adds them up and picks the
splits. Only these, one row for each node, come to the driver, and with them the trees, which are as large as the model.

Cells are dealt into blocks by a hash and ordered in them, and a cell's weight follows from the seed, the tree, the block and its place there:
neither partitions nor the number of cores show in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ordered import exact_quantiles
from flowlens.session import saved, scratch_path

#: A feature of at most that many values has a cut between any two of them, even where ``maxBins`` is less.
VALUES = 1024
#: Cells of a block, and blocks that a task holds at a time.
CELLS, BLOCKS = 8192, 64
NODE = "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, " \
       "rightChild int, split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"


class Forest(RandomForestClassifier):
    """Spark's random forest with its parameters and its model, fitted as above. Rows without a label are left out.

    ``minWeightFractionPerNode``, weights of rows and other impurities than gini are not there.
    """

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        rows = saved(rows.where("y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
        top, width = rows.agg(F.max("y"), F.max(F.size("x"))).first()
        if top is None:
            raise ValueError("no labelled rows to fit on")
        edges = find_edges(rows, width, self.getMaxBins())
        trees = grow(blocks_of(rows, edges), [Tree() for _ in range(self.getNumTrees())], edges, top + 1, subset_size(
            self.getFeatureSubsetStrategy(), width, self.getNumTrees()), self.getMaxDepth(), self.getMinInstancesPerNode(),
            self.getMinInfoGain(), self.getSeed(), self.getSubsamplingRate() if self.getBootstrap() else 0.0)
        return self._copyValues(self._model(dataset, trees, edges, top + 1, width))

    def _model(self, dataset: DataFrame, trees: list[Tree], edges: list[np.ndarray], classes: int, width: int) -> RandomForestClassificationModel:
        """Spark's own model: that of roots alone, saved, given the nodes and loaded."""
        spark, path = dataset.sparkSession, scratch_path(dataset.sparkSession, "forest")
        few = spark.createDataFrame([(Vectors.dense([0.0] * width), float(c)) for c in range(classes)], [self.getFeaturesCol(), self.getLabelCol()])
        roots = RandomForestClassifier._fit(self.copy({self.maxDepth: 0, self.bootstrap: False, self.subsamplingRate: 1.0}), few)
        roots.write().save(path)
        nodes = pd.concat([tree.nodes(edges).assign(treeID=i) for i, tree in enumerate(trees)])
        listed = list(zip(nodes["treeID"].tolist(), nodes["node"]))
        spark.createDataFrame(listed, f"treeID int, nodeData struct<{NODE}>", verifySchema=False).write.mode("overwrite").parquet(f"{path}/data")
        return RandomForestClassificationModel.load(path)


class Tree:
    """Nodes in the order they were made, the root first; a leaf has no children (-1). Bins up to ``cut`` go left."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.gain = [-1], [-1], [-1], [-1], [-1.0]
        self.counts: list[np.ndarray | None] = [None]

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children = len(self.left), len(self.left) + 1
        for column in (self.feature, self.cut, self.left, self.right):
            column += [-1, -1]
        self.gain += [-1.0, -1.0]
        self.counts += [left, right]
        return children

    def nodes(self, edges: list[np.ndarray]) -> pd.DataFrame:
        out = []
        for i, (f, cut, left, right, gain, counts) in enumerate(zip(self.feature, self.cut, self.left, self.right, self.gain, self.counts)):
            split = (f, [float(edges[f][cut])], -1) if left >= 0 else (-1, [], -1)
            out.append((i, float(counts.argmax()), gini(counts), counts.tolist(), int(counts.sum()), gain, left, right, split))
        return pd.DataFrame({"node": out})


def gini(counts: np.ndarray) -> float:
    total = counts.sum()
    return float(1 - ((counts / total) ** 2).sum()) if total else 0.0


def subset_size(strategy: str, width: int, trees: int) -> int:
    """How many features a node looks at, by the names and numbers that Spark's parameter takes."""
    named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3),
             "auto": width if trees == 1 else math.ceil(math.sqrt(width))}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), width) if strategy.isdigit() else math.ceil(float(strategy) * width)


def find_edges(cells: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Per feature the largest value of each bin but the last: cuts between all values if there are few, else exact quantiles of
    the rows. A cut lies in the middle of the two values beside it where there are few."""
    values = saved(cells.select(F.posexplode("x").alias("feature", "value"), "n").groupBy("feature", "value").agg(F.sum("n").alias("n")))
    kinds = {r["feature"]: r["kinds"] for r in values.groupBy("feature").agg(F.count(F.lit(1)).alias("kinds")).collect()}
    many = [f for f, k in kinds.items() if k > max(VALUES, bins)]
    few: list[list[float]] = [[] for _ in range(width)]
    for r in values.where(~F.col("feature").isin(many)).collect():
        few[r["feature"]].append(r["value"])
    sorted_values = [np.sort(np.array(v, float)) for v in few]
    edges = [(v[:-1] + v[1:]) / 2 for v in sorted_values]
    if many:
        each = cells.select(F.posexplode("x").alias("feature", "value"), F.explode(F.sequence(F.lit(1), "n")).alias("_")).where(F.col("feature").isin(many))
        found: dict[int, list[float]] = {f: [] for f in many}
        for r in exact_quantiles(each, ["feature"], "value", bins).where((F.col("step") > 0) & (F.col("step") < bins)).collect():
            found[r["feature"]].append(r["quantile"])
        for f in many:
            edges[f] = np.unique(np.array(found[f], float))
    return edges


def blocks_of(cells: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """``block, x, y, n``: the cells by bins, as arrays in bytes, one row for each block."""
    width = len(edges)

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(list(frame["x"]))
                bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1)
                yield pd.DataFrame({"x": list(bins.astype(np.int32)), "y": frame["y"], "n": frame["n"]})

    merged = saved(cells.mapInPandas(binned, "x array<int>, y int, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n")))
    count = max(1, -(-merged.count() // CELLS))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x, y, n = np.stack(list(frame["x"])).astype(np.int16), frame["y"].to_numpy(np.int32), frame["n"].to_numpy(np.int64)
        order = np.lexsort((y, *x.T))
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "x": [x[order].tobytes()], "y": [y[order].tobytes()], "n": [n[order].tobytes()]})

    dealt = merged.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(count)).cast("int"))
    packed = dealt.groupBy("block").applyInPandas(pack, "block int, x binary, y binary, n binary")
    return saved(packed.repartition(min(count, 2000)))


def grow(blocks: DataFrame, trees: list[Tree], edges: list[np.ndarray], classes: int, subset: int, depth: int, min_rows: int,
         min_gain: float, seed: int, rate: float) -> list[Tree]:
    """All ``trees``, a level of all of them by each pass. ``rate``: rows drawn with replacement, as a share; 0 takes each row once."""
    width, size = len(edges), max(len(e) for e in edges) + 1
    open_ = {i: [0] for i in range(len(trees))}
    for level in range(max(1, depth)):
        looked = {i: np.stack([np.sort(np.random.default_rng([seed % 2**63, i, node]).choice(width, subset, replace=False)) for node in nodes])
                  for i, nodes in open_.items()}
        following: dict[int, list[int]] = {}
        for r in best_splits(blocks, trees, open_, looked, size, classes, min_rows, min_gain, seed, rate).collect():
            tree, whole = trees[r["tree"]], np.array(r["whole"])
            tree.counts[r["node"]] = whole
            if not depth or r["feature"] is None:
                continue
            left = np.array(r["left"])
            for child, counts in zip(tree.split(r["node"], r["feature"], r["cut"], r["gain"], left, whole - left), (left, whole - left)):
                if level + 1 < depth and np.count_nonzero(counts) > 1:
                    following.setdefault(r["tree"], []).append(child)
        open_ = {i: sorted(nodes) for i, nodes in following.items()}
        if not open_:
            break
    for tree in trees:  # a tree that drew no row
        if tree.counts[0] is None:
            tree.counts[0] = np.zeros(classes)
    return trees


def on_the_way(nodes: list[int], left: np.ndarray, right: np.ndarray) -> set[int]:
    """``nodes`` and all above them."""
    parent = np.full(len(left), -1)
    inner = np.flatnonzero(left >= 0)
    parent[left[inner]] = parent[right[inner]] = inner
    out: set[int] = set()
    for node in nodes:
        while node >= 0 and node not in out:
            out.add(int(node))
            node = parent[node]
    return out


class Draws:
    """How often each tree draws the cells of some blocks. What a single row is drawn follows from a hash of seed, tree, block and place, so
    it is worked out for the rows that are asked for alone; cells of more rows are drawn for the whole tree."""

    def __init__(self, chunk: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], n: np.ndarray, seed: int, rate: float):
        self.n, self.seed, self.rate = n, seed % 2**63, rate
        self.blocks = [(block, rate * of[of > 1]) for block, _, _, of in chunk]
        self.many = np.flatnonzero(n > 1)
        self.names = np.concatenate([hashed(np.uint64(block << 32) + np.arange(len(of), dtype=np.uint64)) for block, _, _, of in chunk])
        # As shares of 2^32, below which a Poisson number of mean ``rate`` is at most 0, 1, 2, ...
        terms = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(40)])
        self.below = [t for t in np.rint(terms * 2**32).astype(np.uint64) if t < 2**32]

    def of_tree(self, tree: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For cells, those that the tree draws and how often."""
        if not self.rate:
            return lambda rows: (rows, self.n[rows].astype(float))
        salt = np.random.default_rng([self.seed, tree, 1]).integers(0, 2**63, dtype=np.uint64)
        drawn = np.zeros(len(self.n) if len(self.many) else 0)
        if len(self.many):
            drawn[self.many] = np.concatenate([np.random.default_rng([self.seed, tree, block, 1]).poisson(mean) for block, mean in self.blocks])

        def weight(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u = hashed(self.names[rows] ^ salt) >> np.uint64(32)
            w = np.zeros(len(rows))
            for t in self.below:
                more = u >= t
                if not more.any():
                    break
                w += more
            if len(drawn):
                w = np.where(self.n[rows] > 1, drawn[rows], w)
            kept = np.flatnonzero(w)
            return rows[kept], w[kept]

        return weight


def hashed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def best_splits(blocks: DataFrame, trees: list[Tree], open_: dict[int, list[int]], looked: dict[int, np.ndarray], size: int, classes: int,
                min_rows: int, min_gain: float, seed: int, rate: float) -> DataFrame:
    """``tree, node, feature, cut, gain, left, whole`` of every open node; no feature where it stays a leaf."""
    arrays = {i: tuple(np.array(c) for c in (trees[i].feature, trees[i].cut, trees[i].left, trees[i].right)) for i in open_}
    shared = blocks.sparkSession.sparkContext.broadcast((arrays, open_, looked))

    def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, back = np.unique(keys, return_inverse=True)
        return kept, np.bincount(back, weights, len(kept))

    def count(chunk: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], width: int) -> Iterator[pd.DataFrame]:
        shapes, nodes, features = shared.value
        columns = [np.concatenate([c[1][:, f] for c in chunk]) for f in range(width)]
        y, n = np.concatenate([c[2] for c in chunk]), np.concatenate([c[3] for c in chunk])
        slots = [c.astype(np.int32) * classes + y for c in columns]
        draw = Draws(chunk, n, seed, rate)
        for i, (feature, cut, left, right) in shapes.items():
            above = on_the_way(nodes[i], left, right)
            place = {node: j for j, node in enumerate(nodes[i])}
            weight, keys, sums = draw.of_tree(i), [], []
            # Cells go down together and are dropped where a branch has no open node.
            stack = [(0, np.arange(len(n)))]
            while stack:
                node, rows = stack.pop()
                if left[node] >= 0:
                    goes = columns[feature[node]][rows] <= cut[node]
                    stack += [(child, rows[side]) for child, side in ((left[node], goes), (right[node], ~goes)) if child in above]
                    continue
                rows, w = weight(rows)
                own = place[node]
                for j, f in enumerate(features[i][own]) if len(rows) else ():
                    dense = np.bincount(slots[f][rows], w, size * classes)
                    kept = np.flatnonzero(dense)
                    keys.append(kept + (own * features[i].shape[1] + j) * size * classes)
                    sums.append(dense[kept])
            if keys:
                yield pd.DataFrame({"tree": [i], "keys": [np.concatenate(keys).astype(np.int64).tobytes()], "sums": [np.concatenate(sums).tobytes()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk: list = []
        for frame in frames:
            for block, x, y, n in zip(frame["block"], frame["x"], frame["y"], frame["n"]):
                labels = np.frombuffer(y, np.int32)
                bins = np.frombuffer(x, np.int16).reshape(len(labels), -1)
                chunk.append((block, bins, labels, np.frombuffer(n, np.int64)))
                if len(chunk) == BLOCKS:
                    yield from count(chunk, bins.shape[1])
                    chunk = []
        if chunk:
            yield from count(chunk, chunk[0][1].shape[1])

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        _, nodes, features = shared.value
        i = int(frame["tree"].iloc[0])
        keys, sums = summed(np.concatenate([np.frombuffer(b, np.int64) for b in frame["keys"]]),
                            np.concatenate([np.frombuffer(b, float) for b in frame["sums"]]))
        k = features[i].shape[1]
        step, out = k * size * classes, []
        starts = np.searchsorted(keys, np.arange(len(nodes[i]) + 1) * step)
        for j, node in enumerate(nodes[i]):
            mine = slice(starts[j], starts[j + 1])
            table = np.bincount(keys[mine] - j * step, sums[mine], step).reshape(k, size, classes)
            whole = table[0].sum(0)
            left = np.cumsum(table, 1)[:, :-1]
            right = whole - left
            n_left, n_right, n = left.sum(2), right.sum(2), whole.sum()
            ok = (n_left >= max(min_rows, 1)) & (n_right >= max(min_rows, 1))
            # n times the weighted gini impurity of both sides is n less this
            kept = (left**2).sum(2) / np.maximum(n_left, 1) + (right**2).sum(2) / np.maximum(n_right, 1)
            gain = np.where(ok, kept / max(n, 1) - ((whole / max(n, 1)) ** 2).sum(), -1.0)
            best = int(gain.argmax()) if gain.size else 0
            g = float(gain.flat[best]) if gain.size else -1.0
            if g <= 1e-12 or g < min_gain:
                out.append((i, node, None, None, None, None, whole.tolist()))
            else:
                f, cut = divmod(best, gain.shape[1])
                out.append((i, node, int(features[i][j, f]), cut, g, left[f, cut].tolist(), whole.tolist()))
        found = pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "gain", "left", "whole"], dtype=object)
        return found

    return (blocks.mapInPandas(run, "tree int, keys binary, sums binary").groupBy("tree")
            .applyInPandas(pick, "tree int, node int, feature int, cut int, gain double, left array<double>, whole array<double>"))
