"""Curves, thresholds, splits and bootstrap on small fixtures, against hand values and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import bootstrap as B
from flowlens.operators import metrics as M
from flowlens.operators import ordered as O
from flowlens.operators import slices as SL
from flowlens.operators import splits as SP
from flowlens.operators import thresholds as TH
from flowlens.plans import views as V
from flowlens.plans.catalog import QUERIES
from flowlens.plans.registry import rounded

HAND = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.3, 1), (0.1, 0)]
SCHEMA = "row_id bigint, y_score double, y_true int"


def table(spark, pairs):
    return spark.createDataFrame([(i, float(s) if s is not None else None, y) for i, (s, y) in enumerate(pairs)], SCHEMA)


@pytest.fixture(scope="module")
def random_rows(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.normal(size=3000), 2)
    label = (rng.random(3000) < 1 / (1 + np.exp(-score))).astype(int)
    group = rng.choice(["a", "a", "a", "b", None], 3000)
    rows = [(int(i), float(s), int(y), g) for i, (s, y, g) in enumerate(zip(score, label, group))]
    return rows, spark.createDataFrame(rows, SCHEMA + ", g string").repartition(7).cache()


def brute_curve(pairs):
    out = []
    for t in sorted({s for s, _ in pairs}, reverse=True):
        out.append((t, sum(y for s, y in pairs if s >= t), sum(1 - y for s, y in pairs if s >= t)))
    return out


def test_hand_example(spark):
    curve = M.score_curve(table(spark, HAND))
    got = [(r["threshold"], r["tp"], r["fp"]) for r in curve.orderBy(F.col("threshold").desc()).collect()]
    assert got == [(0.9, 1, 0), (0.8, 1, 1), (0.7, 2, 2), (0.3, 3, 2), (0.1, 3, 3)]
    row = M.summary(curve, budgets=(0.05,)).first()
    assert row["pr_auc"] == pytest.approx(0.7)
    assert row["roc_auc"] == pytest.approx(5.5 / 9)
    assert (row["fpr_at_tpr95"], row["thr_at_tpr95"]) == (pytest.approx(2 / 3), 0.3)
    assert (row["tpr_at_fpr05"], row["thr_at_fpr05"]) == (pytest.approx(1 / 3), 0.9)
    found = {r["budget"]: r["threshold"] for r in TH.kth_negative_thresholds(curve, [0.34, 0.01]).collect()}
    assert found[0.34] == 0.8 and found[0.01] == pytest.approx(0.8 + 1e-12, abs=1e-15)


@pytest.mark.parametrize("rows_per_bucket", [8, 64, 65536])
def test_curve_is_exact_for_any_bucket_size(random_rows, rows_per_bucket):
    rows, df = random_rows
    got = M.score_curve(df, ["g"], rows_per_bucket=rows_per_bucket, look_ahead=True).collect()
    for group in ("a", "b", None):
        pairs = [(s, y) for _, s, y, g in rows if g == group]
        mine = sorted((r for r in got if r["g"] == group), key=lambda r: -r["threshold"])
        assert [(r["threshold"], r["tp"], r["fp"]) for r in mine] == brute_curve(pairs)
        assert {r["n_pos"] for r in mine} == {sum(y for _, y in pairs)}
        assert [r["pos_next"] for r in mine] == [r["pos"] for r in mine[1:]] + [None]
        assert [r["neg_next"] for r in mine] == [r["neg"] for r in mine[1:]] + [None]


@pytest.mark.parametrize("rows_per_bucket", [8, 64, 65536])
@pytest.mark.parametrize("parts", [1, 2, 10, 2000])
def test_quantiles_equal_numpy(random_rows, rows_per_bucket, parts):
    rows, df = random_rows
    got = O.exact_quantiles(df, ["g"], "y_score", parts, rows_per_bucket).collect()
    for group in ("a", "b", None):
        values = [s for _, s, _, g in rows if g == group]
        mine = [r["quantile"] for r in sorted((r for r in got if r["g"] == group), key=lambda r: r["step"])]
        np.testing.assert_allclose(mine, np.quantile(values, np.linspace(0, 1, parts + 1)), atol=1e-9)
    whole = O.exact_quantiles(df, [], "y_score", parts, rows_per_bucket).orderBy("step").collect()
    np.testing.assert_allclose([r["quantile"] for r in whole],
                               np.quantile([r[1] for r in rows], np.linspace(0, 1, parts + 1)), atol=1e-9)


def test_quantiles_of_one_row_and_none(spark):
    one = O.exact_quantiles(table(spark, [(4.0, 1)]), [], "y_score", 4).collect()
    assert sorted(r["step"] for r in one) == [0, 1, 2, 3, 4] and {r["quantile"] for r in one} == {4.0}
    assert O.exact_quantiles(table(spark, []), [], "y_score", 4).count() == 0


def test_one_huge_tie(spark):
    """A third of all rows share one score."""
    pairs = [(0.5, i % 2) for i in range(1000)] + [(i / 2000, i % 3 == 0) for i in range(2000)]
    pairs = [(s, int(y)) for s, y in pairs]
    got = M.score_curve(table(spark, pairs), rows_per_bucket=16).orderBy(F.col("threshold").desc()).collect()
    assert [(r["threshold"], r["tp"], r["fp"]) for r in got] == brute_curve(pairs)


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_results_do_not_depend_on_partitions(random_rows, partitions):
    _, df = random_rows
    moved = df.repartition(partitions)
    first = M.summary(M.score_curve(df, rows_per_bucket=32)).first()
    again = M.summary(M.score_curve(moved, rows_per_bucket=32)).first()
    assert first["pr_auc"] == pytest.approx(again["pr_auc"], abs=1e-12)
    assert first["roc_auc"] == pytest.approx(again["roc_auc"], abs=1e-12)
    sides = {r["row_id"]: r["split"] for r in SP.train_test(df, 0.3, ["y_true"]).collect()}
    assert sides == {r["row_id"]: r["split"] for r in SP.train_test(moved, 0.3, ["y_true"]).collect()}


def test_monotone_maps_keep_areas(random_rows):
    _, df = random_rows
    plain = M.summary(M.score_curve(df)).first()
    mapped = M.summary(M.score_curve(df.withColumn("y_score", F.exp(F.col("y_score") * 2)))).first()
    turned = M.summary(M.score_curve(df.withColumn("y_score", -F.col("y_score")))).first()
    assert plain["pr_auc"] == pytest.approx(mapped["pr_auc"]) and plain["roc_auc"] == pytest.approx(mapped["roc_auc"])
    assert turned["roc_auc"] == pytest.approx(1 - plain["roc_auc"])


@pytest.mark.parametrize("pairs,auc,ap", [
    ([(0.2, 0), (0.4, 0)], None, 0.0), ([(0.2, 1), (0.4, 1)], None, 1.0),
    ([(0.5, 1), (0.5, 0), (0.5, 0), (0.5, 1)], 0.5, 0.5)])
def test_edge_classes(spark, pairs, auc, ap):
    row = M.summary(M.score_curve(table(spark, pairs))).first()
    assert row["roc_auc"] == auc and row["pr_auc"] == pytest.approx(ap)


def test_unscored_rows_are_left_out(spark):
    row = M.summary(M.score_curve(table(spark, HAND + [(None, 1), (float("nan"), 0)]))).first()
    assert (row["n_pos"], row["n_neg"]) == (3, 3) and row["pr_auc"] == pytest.approx(0.7)


def test_kth_negative_without_negatives(spark):
    curve = M.score_curve(table(spark, [(0.3, 1), (0.2, 1)]))
    assert TH.kth_negative_thresholds(curve, [0.05]).first()["threshold"] == math.inf


def test_curve_budget_is_kept(random_rows):
    rows, df = random_rows
    for r in TH.curve_budget(M.score_curve(df), [0.01, 0.05, 0.2]).collect():
        negatives = [s for _, s, y, _ in rows if y == 0]
        assert sum(s >= r["threshold"] for s in negatives) <= r["budget"] * len(negatives)


def test_no_feasible_budget_means_no_alarm(spark):
    curve = M.score_curve(table(spark, [(0.9, 0), (0.5, 1)]))
    assert TH.first_within_budget(curve, [0.01]).first()["threshold"] == math.inf
    assert TH.curve_budget(curve, [0.01]).first()["threshold"] == math.inf


def test_counts_at_equal_brute_force(spark, random_rows):
    rows, df = random_rows
    limits = spark.createDataFrame([("x", -0.5), ("y", 0.25), ("z", math.inf), ("x2", -0.5)], "name string, threshold double")
    for r in TH.counts_at(df, limits, "name").collect():
        assert r["tp"] == sum(y for _, s, y, _ in rows if s >= r["threshold"])
        assert r["fp"] == sum(1 - y for _, s, y, _ in rows if s >= r["threshold"])


def test_splits_are_exact_and_exhaustive(random_rows):
    rows, df = random_rows
    got = {r["row_id"]: (r["split"], r["y_true"]) for r in SP.holdout_halves(df, strata=["y_true"]).collect()}
    assert len(got) == len(rows)
    for label in (0, 1):
        n = sum(y == label for _, _, y, _ in rows)
        hold = math.ceil(0.4 * n)
        counts = {s: sum(v == (s, label) for v in got.values()) for s in ("test", "val", "train")}
        assert counts == {"test": math.ceil(0.5 * hold), "val": hold - math.ceil(0.5 * hold), "train": n - hold}


def test_no_group_on_both_sides(spark):
    df = spark.range(2000).select("id", (F.col("id") % 37).alias("grp"))
    sides = SP.group_split(df, "grp").groupBy("grp").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert {r["n"] for r in sides} == {1} and sum(r["s"] == "test" for r in sides) == math.ceil(0.3 * 37)


def test_calibration_samples_have_their_size(random_rows):
    _, df = random_rows
    got = SP.calibration_samples(df, 100, 6).groupBy("rep").agg(F.count_distinct("row_id").alias("n")).collect()
    assert [r["n"] for r in got] == [100] * 6
    assert SP.calibration_samples(df, 10**6, 2).count() == 2 * df.count()


def test_few_shot_on_a_clean_score(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") / 1000.0).alias("y_score"), (F.col("id") >= 500).cast("int").alias("y_true"))
    got = TH.few_shot_summary(TH.few_shot(df, k=200, reps=5)).first()
    assert got["reps"] == 5 and got["f1_mean"] > 0.97


def test_single_shot_turns_an_inverted_score(random_rows):
    _, df = random_rows
    inverted = df.withColumn("y_score", 0.5 - F.col("y_score") / 10)
    fit, test = TH.single_shot(inverted)
    assert fit.first()["flip"] is True
    assert M.summary(M.score_curve(test)).first()["roc_auc"] > 0.5
    assert test.count() == 3000 - 600


def test_truth_join_refuses_copies_and_orphans(spark):
    truth = spark.createDataFrame([(1, "benign", 0), (2, "scan", 1)], "row_id int, attack_type string, y_true int")
    preds = spark.createDataFrame([(1, 0.2, 1), (2, 0.7, 1), (2, 0.8, 1)], "row_id int, y_score double, y_true int")
    assert [r["y_true"] for r in SL.with_truth(preds, truth).orderBy("y_score").collect()] == [0, 1, 1]
    with pytest.raises(Exception, match="repeated"):
        SL.with_truth(preds, truth.union(truth)).collect()
    lost = preds.union(spark.createDataFrame([(9, 0.1, 0)], preds.schema))
    with pytest.raises(Exception, match="without a truth"):
        SL.with_truth(lost, truth).collect()
    assert SL.orphans(lost, truth).count() == 1


def test_slices_without_benign_rows(spark):
    df = spark.createDataFrame([("scan", 0.5, 1), ("scan", 0.4, 1)], "attack_type string, y_score double, y_true int")
    assert [r["slice"] for r in SL.benign_versus_each(df).collect()] == ["ALL(test)"]


# --- bootstrap ----------------------------------------------------------------------------------------

def test_poisson_weights_have_poisson_moments():
    rng = np.random.default_rng(1)
    coefs = rng.integers(0, B.PRIME, size=(400, 4))
    for mean in (1, 3, 16, 17, 100, 10**6):
        w = B.poisson_weights(coefs, np.full(400, mean), 500)
        assert w.mean() == pytest.approx(mean, rel=0.02) and w.var() == pytest.approx(mean, rel=0.05)


def test_bootstrap_does_not_depend_on_buckets_or_partitions(random_rows):
    _, df = random_rows
    one = B.score_bootstrap(df, ["g"], reps=30, decide_at=0.0).orderBy("g", "rep").collect()
    many = B.score_bootstrap(df.repartition(13), ["g"], reps=30, decide_at=0.0, rows_per_bucket=8).orderBy("g", "rep").collect()
    assert len(one) == 90
    for a, b in zip(one, many):
        assert a["g"] == b["g"] and a["rep"] == b["rep"]
        for m in ("pr_auc", "fpr95", "accuracy"):
            assert a[m] == pytest.approx(b[m], abs=1e-9)


def test_interval_holds_the_point_estimate(random_rows):
    _, df = random_rows
    point = M.summary(M.score_curve(df)).first()["pr_auc"]
    got = B.intervals(B.score_bootstrap(df, reps=200, decide_at=0.0), ["pr_auc"]).first()
    assert got["low"] < point < got["high"] and got["mean"] == pytest.approx(point, abs=0.01)
    assert 0.005 < got["high"] - got["low"] < 0.1


def test_undefined_repetitions(spark):
    per_rep = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.7)], "rep int, fpr95 double")
    assert B.intervals(per_rep, ["fpr95"]).first()["mean"] == pytest.approx(0.6)
    assert B.intervals(per_rep, ["fpr95"], undefined="propagate").first()["mean"] is None


@pytest.mark.parametrize("name,view,reps,groups,options", [
    ("ci_1_score_bootstrap", V.scored, 1000, [], {}), ("ci_1_score_bootstrap_fine", V.scored_fine, 1000, [], {}),
    ("ci_2_score_bootstrap_strict", V.scored, 2000, [], {"decide_at": 0.5}),
    ("ci_4_per_profile", V.scored, 1000, ["profile"], {})])
def test_registered_bootstraps_have_the_full_number_of_resamples(spark, name, view, reps, groups, options):
    folder = "/root/testdata/sf0.001"
    per_rep = B.score_bootstrap(view(spark, folder), groups, reps=reps, **options).cache()
    assert {r["count"] for r in per_rep.groupBy(*groups).count().collect()} == {reps}
    undefined = "propagate" if "decide_at" in options else "skip"
    full = rounded(B.intervals(per_rep, ["pr_auc", "fpr95", "accuracy"], groups, undefined))
    assert sorted(QUERIES[name](spark, folder).collect()) == sorted(full.collect())


def test_registered_few_shot_has_fifty_repetitions(spark):
    folder = "/root/testdata/sf0.001"
    assert {r.rep for r in QUERIES["th_9_few_shot"](spark, folder).collect()} == set(range(1, 51))
    assert QUERIES["th_9_few_shot_summary"](spark, folder).first().reps == 50
    sizes = QUERIES["sp_9_calibration_samples"](spark, folder).groupBy("rep").count().collect()
    assert {(r.rep, r["count"]) for r in sizes} == {(i, 500) for i in range(1, 51)}


def test_every_repetition_has_the_rows_of_its_lowest_draws(spark):
    """k up to half the rows and beyond all of them, ties in draws and keys included, against plain orders of the draws."""
    from flowlens.functions.hashing import PRIME, coefficients, draws, row_hash
    df = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 900).alias("row_id"), (F.col("id") * 1.0).alias("v")).repartition(5)
    rows = df.withColumns({f"a{i}": c for i, c in enumerate(coefficients(row_hash(7, F.col("row_id"))))}).collect()
    coefs = np.array([[r.a0, r.a1, r.a2, r.a3] for r in rows])
    exact = [[((((int(c[3]) * x + int(c[2])) % PRIME) * x + int(c[1])) % PRIME * x + int(c[0])) % PRIME for x in (1, 2, 1999, 4000)] for c in coefs]
    assert draws(coefs, np.array([1, 2, 1999, 4000])).tolist() == exact
    drawn = draws(coefs, np.arange(1, 5))
    for k in (1, 40, 500, 999, 5000):
        got = SP.calibration_samples(df, k, 4).groupBy("rep").agg(F.sort_array(F.collect_list("row_id")).alias("ids")).collect()
        assert sorted(r["rep"] for r in got) == [1, 2, 3, 4]
        for r in got:
            order = sorted((int(drawn[i, r["rep"] - 1]), row.row_id) for i, row in enumerate(rows))
            cut = order[min(k, 1000) - 1]
            assert r["ids"] == sorted(key for d, key in order if (d, key) <= cut)
    assert SP.calibration_samples(df.limit(0), 5, 3).count() == 0


def test_a_bound_that_is_too_low_is_widened(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").cast("string").alias("row_id"))
    want = sorted(tuple(r) for r in SP.calibration_samples(df, 20, 5).select("rep", "row_id").collect())
    monkeypatch.setattr(SP, "ORDERED", 7)
    real, tried = SP._drawn_below, []

    def low_at_first(hashed, schema, bound, reps):
        tried.append(bound)
        return real(hashed, schema, bound // 64 if len(tried) == 1 else bound, reps)

    monkeypatch.setattr(SP, "_drawn_below", low_at_first)
    assert sorted(tuple(r) for r in SP.calibration_samples(df, 20, 5).select("rep", "row_id").collect()) == want
    assert len(tried) == 2


def plain_bootstrap(cells, reps, need=0.95):
    """cells: score, t, hit, weights of all repetitions."""
    out = []
    for r in range(reps):
        pos, neg, hits = Counter(), Counter(), 0.0
        for score, t, hit, w in cells:
            (pos if t else neg)[score] += w[r]
            hits += w[r] * hit
        n_pos, n_neg, tp, fp, gain, fpr = sum(pos.values()), sum(neg.values()), 0.0, 0.0, 0.0, None
        for score in sorted({*pos, *neg}, reverse=True):
            tp, fp = tp + pos[score], fp + neg[score]
            if pos[score] + neg[score] > 0:
                gain += pos[score] * tp / (tp + fp)
                if fpr is None and tp > 0 and tp / n_pos >= need:
                    fpr = fp
        out.append((gain / n_pos if n_pos else 0.0, None if fpr is None or not n_neg else fpr / n_neg,
                    hits / (n_pos + n_neg) if n_pos + n_neg else None))
    return out


def test_score_bootstrap_matches_a_plain_one_for_any_score(spark):
    """Infinite, huge, tiny, negative and nearly equal scores; every range boundary; ties."""
    values = [math.inf, -math.inf, 1e300, -1e300, 1e12, 1e12 + 1, 5e-324, 0.0, -0.25, 1e-12, 2e-12, 0.5, 0.5 + 2**-52, 0.5 + 2**-51]
    rng = random.Random(5)
    rows = [(rng.choice(values), rng.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y_score double, y_true int").withColumn("y_pred", F.lit(1))
    cells = df.groupBy(F.col("y_score").alias("threshold"), F.col("y_true").alias("t"), (F.col("y_true") == 1).cast("int").alias("hit")).count()
    drawn = B._with_coefficients(cells, ["threshold", "t", "hit"], 7).collect()
    assert len({(r.a0, r.a1) for r in drawn}) == len(drawn)  # no two cells share their draws
    reps = 40
    weights = B.poisson_weights(np.array([[r.a0, r.a1, r.a2, r.a3] for r in drawn]), np.array([r["count"] for r in drawn]), reps)
    want = plain_bootstrap([(r.threshold, r.t, r.hit, w) for r, w in zip(drawn, weights)], reps)
    for size in (2, 1000):
        got = B.score_bootstrap(df, reps=reps, rows_per_bucket=size).orderBy("rep").collect()
        assert [r["rep"] for r in got] == list(range(1, reps + 1))
        for r, w in zip(got, want):
            assert (r.pr_auc, r.accuracy) == pytest.approx((w[0], w[2])) and (r.fpr95 is None) == (w[1] is None)
            assert w[1] is None or r.fpr95 == pytest.approx(w[1])


@pytest.mark.parametrize("mean", [1, 2, 30, 5000])
def test_whole_number_limits_are_the_steps_of_the_distribution(mean):
    first, steps = B.poisson_steps(mean)
    start, limits = B.poisson_limits(mean)
    draws = np.unique(np.clip(np.concatenate([limits.astype(np.int64) + d for d in (-1, 0, 1)] + [np.arange(50)]), 0, B.PRIME - 1))
    want = first + np.searchsorted(steps, (draws + 0.5) / B.PRIME, side="left")
    assert start == first and (start + np.searchsorted(limits, draws.astype(np.uint32), side="right") == want).all()
