"""Work that must not grow with the rows, or not fall to few tasks, on small tables."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowlens.operators import bootstrap as B
from flowlens.operators import flows as FL
from flowlens.operators import leafwise as LW
from flowlens.operators.cells import PIECES, Boosted


@pytest.mark.parametrize("mean,cells,reps", [(1, 300, 70), (9, 200, 70), (900, 40, 2100), (2_000_000, 3, 33)])
def test_weights_by_differences_equal_those_drawn_one_by_one(mean, cells, reps):
    rng = np.random.default_rng(mean)
    coefs, counts = rng.integers(0, B.PRIME, (cells, 4)), np.maximum(1, rng.poisson(mean, cells))
    coefs[:3] = [[0] * 4, [B.PRIME - 1] * 4, [B.PRIME - 1, 0, 0, 0]]
    found = np.zeros((reps, cells))
    for here, weights in B.weight_rows(coefs, counts, reps):
        found[here] = weights
    assert (found.T == B.poisson_weights(coefs, counts, reps)).all()


def test_cells_are_dealt_to_tasks_by_number(spark, monkeypatch):
    """A thousand repetitions of a cell are work, however few bytes the cell has."""
    tasks = []

    def saved(df):
        tasks.append(df.rdd.getNumPartitions())
        return df.localCheckpoint()

    monkeypatch.setattr(B, "saved", saved)
    rows = spark.range(3000).select((F.col("id") % 2).alias("y_true"), (F.col("id") / 3000).alias("y_score"), F.lit(1).alias("y_pred"))
    assert B.score_bootstrap(rows, reps=20, rows_per_bucket=8).count() == 20
    assert tasks[0] >= 4 * spark.sparkContext.defaultParallelism


ODD_REPORTS = [
    "TCP Conversations\r\nFilter:<No Filter>\r\na:1   <->  b:2  1 10  2 20  0.5\r\n  fe80::1:7 <-> fe80::2:8 3 30 4 40 1.5  \r\n===\nUDP Conversations  \n"
    "c:3 <-> d:4 5 50 6 60 2.5\nIPv4 Conversations\nstill:5 <-> udp:6 1 1 1 1 1",
    "e:1 <-> f:2 1 1 1 1 1\n UDP Conversations of some\ng:1 <-> h:2 1 1 1 1 1", "TDP Conversations\ni:1 <-> j:2 1 1 1 1 1",
    "UDP Conversations\rk:1 <-> l:2 1 1 1 1 1\nm:1 <-> n:2 x 1 1 1 1\no:p <-> q:2 1 1 1 1 1\nr:1 s:2 <-> 1 1 1 1 1\nt:1 <-> u:2 1 1 1 1",
    "TCP Conversations\nv:1\t<->\tw:2\t1\t2\t3\t4\t9\textra <->", "", None]


def test_reports_are_parsed_with_one_split_of_a_line(spark):
    flows = FL.parse_conversations(spark.createDataFrame([(r,) for r in ODD_REPORTS], "value string"))
    got = sorted((r.proto, r.saddr, r.sport, r.daddr, r.dport, r.spkts, r.sbytes, r.dpkts, r.dbytes, r.dur) for r in flows.collect())
    assert got == [
        ("tcp", "a", "1", "b", "2", 1, 10, 2, 20, 0.5), ("tcp", "fe80::1", "7", "fe80::2", "8", 3, 30, 4, 40, 1.5),
        ("tcp", "v", "1", "w", "2", 1, 2, 3, 4, 9.0), ("udp", "c", "3", "d", "4", 5, 50, 6, 60, 2.5), ("udp", "still", "5", "udp", "6", 1, 1, 1, 1, 1.0)]
    plan = flows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s+") == 1


def test_leafwise_passes_are_over_counts_of_equal_rows(spark, monkeypatch):
    """The same trees from rows that are there five times as from their number, in passes over as many rows as there are different ones."""
    seen, sums = [], LW.leaf_sums
    monkeypatch.setattr(LW, "leaf_sums", lambda rows, *a: seen.append(rows.agg(F.count("*"), F.sum("n")).first()) or sums(rows, *a))
    rows = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                   ((F.col("id") * 13 % 11 + F.col("id") % 7) > 8).cast("int").alias("y_true"))
    model = LW.fit(rows.crossJoin(spark.range(5).drop("id")), ["a", "b"], rounds=2, leaves=6, min_rows=20)
    assert model.trees and all(some <= 70 and whole == 3000 for some, whole in seen)


def test_boosting_is_over_distinct_rows_with_weights(spark, monkeypatch):
    """Rows that are there twenty times give the trees of Spark's own fit, from as many rows as there are different ones; drawn
    in parts where a round draws; a leaf's least number counts rows."""
    base = spark.range(200).select((F.col("id") % 8).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                   ((F.col("id") * 13 % 11 + F.col("id") % 8) > 8).cast("double").alias("y_true"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(base.crossJoin(spark.range(20).drop("id"))).cache()
    kinds, fitted = base.distinct().count(), []
    plain = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, df: fitted.append(df.count()) or plain(self, df))
    options = {"featuresCol": "features", "labelCol": "y_true", "maxIter": 3, "maxDepth": 3, "seed": 7}
    for more in ({}, {"minInstancesPerNode": 300}):
        own, same = (kind(**options, **more).fit(rows) for kind in (Boosted, GBTClassifier))
        assert fitted[-2:] == [kinds, 4000] and own.getMinInstancesPerNode() == same.getMinInstancesPerNode()
        assert not own.isDefined(own.weightCol)
        shown = [m.transform(rows).select("a", "b", F.round(vector_to_array("probability")[1], 9).alias("p")).distinct() for m in (own, same)]
        assert sorted(shown[0].collect()) == sorted(shown[1].collect())
    Boosted(**options, subsamplingRate=0.8).fit(rows)
    assert fitted[-1] == kinds * PIECES
