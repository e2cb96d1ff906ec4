"""Values that are missing, not numbers, or out of range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.cleaning import protocol_any
from flowlens.operators import bootstrap as B
from flowlens.operators import features, labels, shift
from flowlens.operators import metrics as M
from flowlens.operators import thresholds as TH

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([("a", 0.9, 1), ("b", NAN, 0), ("c", None, 1), ("d", 0.1, 0), ("e", 0.5, None)],
                                 "row_id string, y_score double, y_true int")


def test_no_number_raises_no_alarm(scored):
    got = {r.row_id: r.y_pred for r in TH.fixed_decision(scored).collect()}
    assert got == {"a": 1, "b": 0, "c": None, "d": 0, "e": 1}


def test_counts_at_has_the_population_of_the_curve(spark, scored):
    at = spark.createDataFrame([("x", 0.5)], "name string, threshold double")
    row = TH.counts_at(scored, at, "name").first()
    curve = M.score_curve(scored).first()
    assert (row.tp, row.fp, row.n_pos, row.n_neg) == (1, 0, 1, 1) and (curve.n_pos, curve.n_neg) == (1, 1)


def test_budgets_have_names_of_their_own():
    names = [TH._percent(b) for b in (0.001, 0.004, 0.01, 0.05, 0.1, 1.0)]
    assert len(set(names)) == len(names) and names[2:4] == ["fpr01", "fpr05"]


def test_strict_threshold_keeps_the_budget(spark):
    rows = spark.createDataFrame([(0.9, 1)] + [(0.5, 0)] * 5 + [(0.1, 0)] * 5, "y_score double, y_true int")
    curve = M.score_curve(rows)
    strict = {r.budget: r.threshold for r in TH.kth_negative_thresholds(curve, [0.2, 0.5], strict=True).collect()}
    assert strict == {0.2: 0.9, 0.5: 0.5}


@pytest.mark.parametrize("mean", [1, 16, 17, 1000, 1_000_000])
def test_poisson_steps(mean):
    first, steps = B.poisson_steps(mean)
    chances, k = np.diff(np.concatenate([[0], steps])), first + np.arange(len(steps))
    assert np.isclose((k * chances).sum(), mean) and np.isclose(((k - mean) ** 2 * chances).sum(), mean)


def test_labels_scales_protocols_and_dates(spark):
    rows = spark.createDataFrame([("NaN",), ("0",), ("1",), (None,), ("x",)], "label string")
    assert [r.y_true for r in labels.numeric_label(rows).collect()] == [0, 0, 1, 0, 0]
    values = spark.createDataFrame([(1.0,), (3.0,), (INF,), (None,)], "v double")
    assert features.fit_scales(values, ["v"]).first().scale == 1.0
    big = spark.createDataFrame([("99999999999",), ("6.0",)], "p string").select(protocol_any(F.col("p")).alias("p"))
    assert [r.p for r in big.collect()] == ["99999999999", "tcp"]
    days = spark.sql("select date'2024-01-01' as d, 1 as n")
    assert shift.common_columns(days, days) == (["n"], ["d"])


def test_a_fitted_table_is_broadcast_by_rows_and_bytes(spark):
    from flowlens.functions.relational import fitted
    table = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(fitted(table)) and not hinted(fitted(table, max_rows=999)) and not hinted(fitted(table, max_bytes=10_000))
    assert fitted(table.limit(0)).count() == 0 and fitted(table, max_bytes=10_000).count() == 1000
