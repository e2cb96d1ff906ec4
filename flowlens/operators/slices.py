"""Joining predictions to the truth and reporting per kind of attack."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import attach, require_columns
from flowlens.operators import metrics as M


def with_truth(preds: DataFrame, truth: DataFrame, key: str = "row_id", unmatched: str = "fail") -> DataFrame:
    """Every prediction with the truth's ``attack_type`` and ``y_true``; at most one truth per key.

    The truth is reduced to one row per key before the join, so a key repeated there cannot multiply
    predictions; such a key, and with ``unmatched="fail"`` a prediction without truth, stops the query.
    """
    require_columns(truth, [key, "attack_type", "y_true"])
    require_columns(preds, [key, "y_score"])
    single = truth.groupBy(key).agg(F.count(F.lit(1)).alias("__copies"), F.first("attack_type").alias("attack_type"),
                                    F.first("y_true").alias("y_true"))
    joined = preds.drop("attack_type", "y_true").join(single, key, "left")
    once = F.assert_true(F.coalesce(F.col("__copies"), F.lit(1)) == 1, F.lit(f"truth has a repeated {key}"))
    found = F.assert_true(F.col("__copies").isNotNull(), F.lit(f"prediction without a truth row for its {key}"))
    checked = joined.where(once.isNull())
    if unmatched == "fail":
        checked = checked.where(found.isNull())
    return checked.drop("__copies")


def orphans(preds: DataFrame, truth: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions whose key the truth does not have."""
    return preds.join(truth.select(key), key, "left_anti")


def slice_report(df: DataFrame, groups: Sequence[str], score: str = "y_score", label: str = "y_true") -> DataFrame:
    """n, positive rate, PR-AUC, ROC-AUC and mean scores per group, all from one score curve.

    PR-AUC is null without positives, ROC-AUC with one class only.
    """
    return _report(M.score_curve(df, groups, score=score, label=label), groups)


def benign_versus_each(df: DataFrame, kind: str = "attack_type", benign: str = "benign",
                       score: str = "y_score", label: str = "y_true") -> DataFrame:
    """A report for all rows and for the benign rows with each attack kind in turn.

    Benign scores are counted once and their counts, not their rows, are repeated per kind. A table without
    benign rows gets only the overall line.
    """
    counts = M.score_counts(df.withColumn(kind, F.coalesce(F.col(kind).cast("string"), F.lit("nan"))), [kind],
                            score, label)
    kinds = counts.groupBy(kind).agg(F.lit(1).alias("__one"))
    listed = kinds.agg(F.sort_array(F.collect_set(F.when(F.col(kind) != benign, F.col(kind)))).alias("k"),
                       F.max(F.when(F.col(kind) == benign, 1)).alias("has"))
    located = attach(counts, listed, [])
    prefix = F.lit(f"{benign} vs ")
    everything = F.array(F.lit("ALL(test)"))
    each = F.transform("k", lambda x: F.concat(prefix, x))
    own = F.array(F.concat(prefix, F.col(kind)))
    slices = (F.when(F.col("has").isNull(), everything)
              .when(F.col(kind) == benign, F.concat(everything, each)).otherwise(F.concat(everything, own)))
    spread = (located.withColumn("slice", F.explode(slices))
              .select("slice", F.col("threshold").alias("y_score"),
                      F.inline(F.array(F.struct(F.lit(1).alias("y_true"), F.col("pos").alias("__w")),
                                       F.struct(F.lit(0).alias("y_true"), F.col("neg").alias("__w")))))
              .where("__w > 0"))
    curve = M.score_curve(spread, ["slice"], weight="__w")
    return _report(curve, ["slice"])


def _report(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    found = curve.groupBy(*groups).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        M.average_precision().alias("pr_auc"), M.roc_auc().alias("roc_auc"),
        F.sum(F.col("threshold") * F.col("pos")).alias("__pos"), F.sum(F.col("threshold") * F.col("neg")).alias("__neg"))
    return found.select(
        *groups, (F.col("n_pos") + F.col("n_neg")).alias("n"),
        M.ratio(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")).alias("pos_rate"),
        F.when(F.col("n_pos") > 0, F.col("pr_auc")).alias("pr_auc"), "roc_auc",
        M.ratio(F.col("__pos"), F.col("n_pos")).alias("mean_score_pos"),
        M.ratio(F.col("__neg"), F.col("n_neg")).alias("mean_score_neg"))


def positive_slices(df: DataFrame, groups: Sequence[str], **columns: str) -> DataFrame:
    """PR-AUC of the slices that hold positives, with both class counts to judge it by."""
    curve = M.score_curve(df, groups, **columns)
    return (M.summary(curve, groups).where("n_pos > 0").select(*groups, "n_pos", "n_neg", "pr_auc"))
