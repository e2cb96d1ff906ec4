"""Fitted pipelines and the boosted model after every round."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import models as ML
from flowlens.operators import staged as ST
from flowlens.session import scratch_path

COLUMNS = "row_id long, y_true int, a double, b string, c double, p string, q string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        out.append((i, y, None if i % 7 == 0 else float(rng.normal(1.5 * y)), "junk" if i % 11 == 0 else str(round(float(rng.normal(y)), 3)),
                    math.inf if i % 13 == 0 else None if i % 17 == 0 else float(rng.integers(0, 50)),
                    None if i % 5 == 0 else ["tcp", "udp"][int(rng.random() < 0.4)], None))
    return spark.createDataFrame(out, COLUMNS)


NUMERIC, TEXT = ["a", "b", "c"], ["p", "q"]


def number(x):
    try:
        x = float(x)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def test_fitted_values_are_those_of_the_training_rows(spark, rows):
    train = rows.where("row_id < 400")
    model = ML.fit(train, ML.logistic(5), NUMERIC, TEXT)
    filled, scales = ML.fitted_values(model)
    known = train.collect()
    for c in NUMERIC:
        values = [number(r[c]) for r in known]
        median = float(np.median([v for v in values if v is not None]))
        assert filled[c] == pytest.approx(median)
        assert scales[c] == pytest.approx(np.std([median if v is None else v for v in values]))
    assert filled["p"] == "tcp" and filled["q"] == "unk"
    assert ML.feature_list(model) == (NUMERIC, TEXT)


@pytest.mark.parametrize("build,text", [
    (lambda: ML.logistic(20), TEXT), (lambda: ML.forest(5, 4), TEXT), (lambda: ML.boosted(4, 3, 0.3), TEXT),
    (lambda: ML.perceptron(3, hidden=(5,), iterations=5), [])])
def test_a_saved_pipeline_scores_alike(spark, rows, build, text):
    train, test = rows.where("row_id < 400"), rows.where("row_id >= 400")
    numeric = NUMERIC
    model = ML.fit(train, build(), numeric, text)
    path = scratch_path(spark, "model")
    ML.save(model, path)
    again = ML.load(path)
    assert ML.feature_list(again) == (numeric, text) and ML.fitted_values(again) == ML.fitted_values(model)
    one, two = ({r.row_id: r.y_score for r in ML.score(m, test).collect()} for m in (model, again))
    assert one == two and len(one) == 200
    assert set(model.transform(test).columns) > set(test.columns)
    assert model.transform(test).select(test.columns).subtract(test).count() == 0  # a table's own columns stay as they are


def test_a_new_table_may_lack_features(spark, rows):
    model = ML.fit(rows, ML.logistic(20), NUMERIC, TEXT)
    got = ML.score_new(model, rows.select("row_id", "a"))
    filled = ML.score(model, rows.select("row_id", "a", F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit("unk").alias("p"), F.lit("unk").alias("q")),
                      ["row_id"])
    assert sorted(got.collect()) == sorted(filled.collect()) and got.count() == 600
    imputed = ML.fit(rows, ML.logistic(20), NUMERIC, TEXT, absent="null")
    values, _ = ML.fitted_values(imputed)
    same = rows.select("row_id", "a", *[F.lit(values[c]).alias(c) for c in ("b", "c", "p", "q")])
    assert sorted(ML.score_new(imputed, rows.select("row_id", "a")).collect()) == sorted(ML.score(imputed, same, ["row_id"]).collect())
    assert ML.score(model, rows.limit(0)).count() == 0


def test_columns_without_a_value(spark):
    rows = spark.createDataFrame([(i, i % 2, None, None) for i in range(20)], "row_id long, y_true int, a double, p string")
    model = ML.fit(rows, ML.logistic(3), ["a"], ["p"])
    assert ML.fitted_values(model) == ({"a": 0.0, "p": "unk"}, {"a": 1.0})
    assert {round(r.y_score, 6) for r in ML.score(model, rows).collect()} == {0.5}


def test_average_precision_of_each_round_is_that_of_a_refit(spark, rows):
    """One-hot columns are categories to a tree, numbers are thresholds: both kinds of split occur."""
    train, val = rows.where("row_id < 400").cache(), rows.where("row_id >= 400").cache()
    made = lambda rounds: ML.fit(train, ML.boosted(rounds, 3, 0.3), NUMERIC, TEXT)
    full = made(6)
    best, short, table = ML.best_rounds(full, val)
    got = {r["round"]: r.pr_auc for r in table.collect()}
    assert sorted(got) == list(range(1, 7)) and len(set(got.values())) > 2
    for rounds in (1, 3, 6):
        refit = ML.score(made(rounds), val)
        assert got[rounds] == pytest.approx(M.summary(M.score_curve(refit)).first()["pr_auc"])
    assert best == min(got, key=lambda r: (-got[r], r)) and len(short.stages[-1].trees) == best
    want = {r.row_id: r.y_score for r in ML.score(made(best), val).collect()}
    assert {r.row_id: r.y_score for r in ML.score(short, val).collect()} == pytest.approx(want)


def test_margins_are_counted_by_round(spark, rows):
    model = ML.fit(rows, ML.boosted(3, 2, 0.5), NUMERIC, TEXT)
    featured = rows
    for stage in model.stages[:-1]:
        featured = stage.transform(featured)
    counts = ST.staged_margins(model.stages[-1], featured)
    assert {r["round"]: r.n for r in counts.groupBy("round").agg(F.sum("n").alias("n")).collect()} == {1: 600, 2: 600, 3: 600}
    last = {round(r.margin, 9) for r in counts.where("round = 3").collect()}
    raw = {round(r.rawPrediction[1], 9) for r in model.transform(rows).select("rawPrediction").collect()}
    assert last == raw
    with pytest.raises(ValueError):
        ST.prefix(model.stages[-1], 4)
    with pytest.raises(ValueError):
        ST.best_prefix(model.stages[-1], featured.limit(0))
