"""Choosing decision thresholds: best F1, alarm budgets, few-shot and single-shot calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import attach, ratio
from flowlens.operators import metrics as M
from flowlens.operators.ordered import position, search_steps
from flowlens.operators.splits import calibration_samples, calibration_split
from flowlens.session import saved

INF = float("inf")

# Guard added to denominators and to the largest negative score.
TINY = 1e-12


def fixed_decision(df: DataFrame, cut: float = 0.5, score: str = "y_score") -> DataFrame:
    """Predict 1 at or above ``cut``; a missing score stays undecided, one that is no number is 0."""
    return df.withColumn("y_pred", M.alarms(F.col(score), F.lit(cut)))


def best_f1_on_curve(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Best F1 over all distinct scores; among equals the lowest threshold."""
    p, r = F.col("precision"), F.col("tpr")
    f1 = 2.0 * p * r / (p + r + F.lit(TINY))
    best = curve.groupBy(*groups).agg(F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("down"))).alias("b"))
    return best.select(*groups, (-F.col("b.down")).alias("threshold"), F.col("b.f1").alias("f1"))


def at_tpr(curve: DataFrame, target: float, groups: Sequence[str] = (), fallback: float = 0.0) -> DataFrame:
    """Highest threshold whose TPR reaches ``target``; ``fallback`` if none does."""
    found = curve.groupBy(*groups).agg(M.fpr_point(target).alias("p"))
    return found.select(*groups, F.coalesce(F.col("p.threshold"), F.lit(fallback)).alias("threshold"), "p.tpr")


def at_fpr(curve: DataFrame, budget: float, groups: Sequence[str] = (), fallback: float = 1.0) -> DataFrame:
    """Threshold of the largest TPR with FPR within ``budget``; ``fallback`` without negatives."""
    found = curve.groupBy(*groups).agg(M.tpr_point(budget).alias("p"))
    return found.select(*groups, F.coalesce(F.col("p.threshold"), F.lit(fallback)).alias("threshold"),
                        F.col("p.tpr").alias("tpr"))


def curve_budget(curve: DataFrame, budgets: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Per budget, the threshold of the largest TPR within it; +inf (no alarms) if nothing fits."""
    found = curve.groupBy(*groups).agg(F.array(*[
        F.struct(F.lit(float(b)).alias("budget"),
                 F.coalesce(M.tpr_point(b)["threshold"], F.lit(INF)).alias("threshold")) for b in budgets]).alias("x"))
    return found.select(*groups, F.inline("x"))


def first_within_budget(curve: DataFrame, budgets: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Highest distinct score whose FPR is within the budget, or +inf.

    FPR only grows as the threshold falls, so this is either the top score or nothing. Kept for the results
    it must match; ``curve_budget`` is the useful rule.
    """
    found = curve.groupBy(*groups).agg(F.array(*[
        F.struct(F.lit(float(b)).alias("budget"),
                 F.coalesce(F.max(F.when(F.col("fpr") <= F.lit(float(b)), F.col("threshold"))), F.lit(INF))
                 .alias("threshold")) for b in budgets]).alias("x"))
    return found.select(*groups, F.inline("x"))


def kth_negative(budget: float) -> Column:
    """The k-th highest negative score, k = floor(budget · negatives), as an aggregate over a score curve.

    k = 0 gives just above the largest negative, and no negatives give +inf. Scores equal to the k-th
    negative also alarm, so the realised FPR may pass the budget.
    """
    allowed = F.floor(F.lit(float(budget)) * F.col("n_neg"))
    kth = F.max(F.when((allowed > 0) & (F.col("fp") >= allowed), F.col("threshold")))
    above_all = F.max(F.when(F.col("neg") > 0, F.col("threshold"))) + F.lit(TINY)
    return F.coalesce(kth, above_all, F.lit(INF))


def kth_negative_strict(budget: float) -> Column:
    """As ``kth_negative`` without ever passing the budget: the lowest score with at most k negatives at or above it,
    or just above the highest score if even that has more; no negatives give +inf."""
    lowest = F.min(F.when(F.col("fp") <= F.floor(F.lit(float(budget)) * F.col("n_neg")), F.col("threshold")))
    above_all = F.max("threshold") + F.lit(TINY)
    return F.when(F.max("n_neg") > 0, F.coalesce(lowest, above_all)).otherwise(F.lit(INF))


def kth_negative_thresholds(curve: DataFrame, budgets: Sequence[float], groups: Sequence[str] = (),
                            strict: bool = False) -> DataFrame:
    rule = kth_negative_strict if strict else kth_negative
    found = curve.groupBy(*groups).agg(F.array(*[
        F.struct(F.lit(float(b)).alias("budget"), rule(b).alias("threshold")) for b in budgets]).alias("x"))
    return found.select(*groups, F.inline("x"))


def best_f1_on_grid(curve: DataFrame, parts: int = 2000, groups: Sequence[str] = ()) -> DataFrame:
    """Best F1 over a grid of score quantiles; among equals the lowest threshold."""
    grid = M.quantile_grid(curve, parts, groups)
    f1 = M.or_zero(ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")))
    best = grid.groupBy(*groups).agg(F.max(F.struct(
        f1.alias("f1"), (-F.col("step")).alias("down"), F.col("quantile").alias("threshold"),
        F.col("tp"), F.col("fp"), F.col("n_pos"))).alias("b"))
    return best.select(
        *groups, "b.threshold", "b.f1",
        M.or_zero(ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fp"))).alias("precision"),
        M.or_zero(ratio(F.col("b.tp"), F.col("b.n_pos"))).alias("recall"))


def orientation(df: DataFrame, groups: Sequence[str] = (), score: str = "y_score",
                label: str = "y_true") -> DataFrame:
    """Average precision of the score and of 1 - score; ``flip`` if the latter is strictly larger.

    Both directions come from one set of distinct scores: the reversed curve needs only the counts below.
    """
    curve = M.score_curve(df.select(*groups, score, label), groups, score=score, label=label)
    below_pos, below_neg = F.col("n_pos") - F.col("tp") + F.col("pos"), F.col("n_neg") - F.col("fp") + F.col("neg")
    reversed_gain = F.sum(F.col("pos") * ratio(below_pos, below_pos + below_neg))
    found = curve.groupBy(*groups).agg(
        M.average_precision().alias("ap"),
        F.coalesce(reversed_gain / F.nullif(F.max("n_pos"), F.lit(0)), F.lit(0.0)).alias("ap_flipped"))
    return found.withColumn("flip", F.col("ap_flipped") > F.col("ap"))


def flipped(df: DataFrame, cut: float = 0.5, score: str = "y_score") -> DataFrame:
    """Scores turned to 1 - score, decisions made anew."""
    return fixed_decision(df.withColumn(score, F.lit(1.0) - F.col(score)), cut, score)


def oriented(df: DataFrame, flip: DataFrame, groups: Sequence[str] = (), score: str = "y_score") -> DataFrame:
    """Scores turned where ``flip`` says so (one row per group)."""
    marked = attach(df, flip.select(*groups, F.col("flip").alias("__flip")), groups)
    turned = F.when(F.col("__flip"), F.lit(1.0) - F.col(score)).otherwise(F.col(score))
    return marked.withColumn(score, turned).drop("__flip")


def counts_at(df: DataFrame, thresholds: DataFrame, ident: str, score: str = "y_score",
              label: str = "y_true") -> DataFrame:
    """Confusion counts of all scored rows at each of a few thresholds, in one pass.

    ``thresholds`` has (``ident``, ``threshold``) and is small by construction (repetitions, budgets). Rows
    are counted between neighbouring thresholds map-side; sums over those few counts give every answer. Rows
    without a score or a label count nowhere, as in the curves.
    """
    listed = thresholds.agg(F.sort_array(F.collect_set("threshold")).alias("__t"))
    listed = listed.withColumn("__steps", search_steps("__t"))
    rows = (attach(M.scored_rows(df, [], score, label), listed, [])
            .withColumn("__at", position("threshold", "__t")))
    between = rows.groupBy("__at").agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    table = between.agg(F.collect_list(F.struct("__at", "pos", "neg")).alias("c")).scalar()
    located = (attach(thresholds, listed, []).withColumn("__c", table)
               .withColumn("__need", F.array_position("__t", F.col("threshold"))))

    def total(field: str, at_or_above: bool) -> Column:
        def add(acc: Column, x: Column) -> Column:
            keep = (x["__at"] >= F.col("__need")) if at_or_above else F.lit(True)
            return acc + F.when(keep, x[field]).otherwise(0)
        return F.aggregate("__c", F.lit(0).cast("bigint"), add)

    return located.select(ident, "threshold", total("pos", True).alias("tp"), total("neg", True).alias("fp"),
                          total("pos", False).alias("n_pos"), total("neg", False).alias("n_neg"))


def few_shot(df: DataFrame, k: int = 500, reps: int = 50, seed: int = 7, parts: int = 1000,
             key: str = "row_id", score: str = "y_score", label: str = "y_true") -> DataFrame:
    """Per repetition, fit best-F1 on ``k`` sampled rows and test on all others.

    The test counts are those of the whole table less those of the sample, so testing costs one pass for
    all repetitions together. Rows without a score or a label are neither sampled nor counted.
    """
    df = M.scored_rows(df, [key], score, label).withColumnRenamed("threshold", score)
    sample = saved(calibration_samples(df.select(key, score, label), k, reps, seed, key))
    curve = M.score_curve(sample, ["rep"], score=score, label=label)
    chosen = best_f1_on_grid(curve, parts, ["rep"]).select("rep", "threshold")
    chosen = saved(chosen)
    everywhere = counts_at(df, chosen, "rep", score, label)
    inside = (sample.join(F.broadcast(chosen), "rep")
              .groupBy("rep").agg(
                  F.sum(F.when((F.col(score) >= F.col("threshold")) & (F.col(label) == 1), 1).otherwise(0)).alias("s_tp"),
                  F.sum(F.when((F.col(score) >= F.col("threshold")) & (F.col(label) != 1), 1).otherwise(0)).alias("s_fp"),
                  F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("s_pos")))
    rest = everywhere.join(inside, "rep").select(
        "rep", "threshold", (F.col("tp") - F.col("s_tp")).alias("tp"), (F.col("fp") - F.col("s_fp")).alias("fp"),
        (F.col("n_pos") - F.col("s_pos") - F.col("tp") + F.col("s_tp")).alias("fn"))
    return rest.select(
        "rep", "threshold",
        M.or_zero(ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        M.cell_precision().alias("precision"), M.cell_recall().alias("recall"))


def few_shot_summary(results: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the repetitions."""
    return results.agg(F.count(F.lit(1)).alias("reps"), *[
        agg(m).alias(f"{m}_{name}") for m in ("f1", "precision", "recall")
        for name, agg in (("mean", F.avg), ("std", F.stddev_pop))])


def evaluation_block(df: DataFrame, named_thresholds: DataFrame, score: str = "y_score",
                     label: str = "y_true") -> DataFrame:
    """Accuracy, P, R, F1 and FPR at each named threshold, with the score's own PR-AUC and FPR@95."""
    cells = counts_at(df, named_thresholds, "name", score, label).withColumns({
        "fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})
    rates = M.with_rates(cells).withColumn("fpr", F.col("fp") / F.greatest(F.lit(1), F.col("n_neg")))
    whole = M.summary(M.score_curve(df, score=score, label=label)).select("pr_auc", F.col("fpr_at_tpr95").alias("fpr95"))
    return attach(rates.select("name", "threshold", "accuracy", "precision", "recall", "f1", "fpr"), whole, [])


def single_shot(df: DataFrame, fraction: float = 0.2, seed: int = 7, budgets: Sequence[float] = (0.01, 0.05),
                key: str = "row_id", score: str = "y_score", label: str = "y_true") -> tuple[DataFrame, DataFrame]:
    """Fit orientation and budget thresholds on a calibration part, evaluate once on the rest.

    The split is written once, so that the curves after it are plain scans. Returns the fitted row and the
    test rows (``key``, ``label``) with turned scores, ``y_pred`` at 0.5 and one
    ``y_pred_<budget>`` per budget.
    """
    parts = saved(calibration_split(df.select(key, score, label), fraction, seed, key))
    calib, test = parts.where("split = 'calib'"), parts.where("split = 'test'").drop("split")
    facing = orientation(calib, score=score, label=label)
    curve = M.score_curve(oriented(calib, facing, score=score), score=score, label=label)
    limits = curve.agg(*[kth_negative(b).alias(f"threshold_{_percent(b)}") for b in budgets])
    fit = saved(attach(facing, limits, []))
    rows = oriented(test, fit, score=score)
    rows = attach(rows, fit.select(*limits.columns), [])
    decided = fixed_decision(rows, score=score).withColumns({
        f"y_pred_{_percent(b)}": M.alarms(F.col(score), F.col(f"threshold_{_percent(b)}")) for b in budgets})
    return fit, decided.drop(*limits.columns)


def _percent(budget: float) -> str:
    """A name of its own for every budget: ``fpr05`` for whole percents, ``fpr00_4`` for four in a thousand."""
    whole, _, rest = f"{budget * 100:.10f}".rstrip("0").partition(".")
    return f"fpr{int(whole):02d}" + (f"_{rest}" if rest else "")
