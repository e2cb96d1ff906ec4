"""Curves and metrics of scored tables.

Every function takes optional ``groups`` and, where it makes sense, a ``weight`` column. Undefined values
(no positives, no negatives) are null. Rows without a score or a label are not scored rows and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.relational import attach, fitted, ratio
from flowlens.operators.ordered import ROWS_PER_BUCKET, grid_points, running
from flowlens.session import saved

INF = float("inf")


def scored_rows(df: DataFrame, groups: Sequence[str], score: str, label: str, *more: str) -> DataFrame:
    """Rows that have a score and a label, the score as double ``threshold``."""
    return (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
            .select(*groups, F.col(score).cast("double").alias("threshold"), label, *more))


def score_counts(df: DataFrame, groups: Sequence[str] = (), score: str = "y_score", label: str = "y_true",
                 weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: combined map-side, so ties never travel as rows."""
    amount = F.col(weight) if weight else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("double" if weight and df.schema[weight].dataType.typeName() in ("double", "float")
                         else "bigint")
    return (scored_rows(df, groups, score, label, *([weight] if weight else []))
            .groupBy(*groups, "threshold")
            .agg(F.sum(F.when(F.col(label) == 1, amount).otherwise(zero)).alias("pos"),
                 F.sum(F.when(F.col(label) == 1, zero).otherwise(amount)).alias("neg")))


def score_curve(df: DataFrame, groups: Sequence[str] = (), score: str = "y_score", label: str = "y_true",
                weight: str | None = None, look_ahead: bool = False,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per distinct score with exact counts of everything scored at or above it.

    Columns: ``groups``, ``threshold``, ``pos``/``neg`` at the score, ``tp``/``fp`` at or above it,
    ``n_pos``/``n_neg`` of the group, and ``tpr``, ``fpr``, ``precision``.
    """
    # Read once; the ranges of scores are then found and summed from the saved counts.
    counts = saved(score_counts(df, groups, score, label, weight))
    summed = running(counts, counts.select(*groups, "threshold"), groups, "threshold", ["pos", "neg"], look_ahead=look_ahead,
                     rows_per_bucket=rows_per_bucket)
    named = summed.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp", "pos_all": "n_pos", "neg_all": "n_neg"})
    return named.withColumns({
        "tpr": ratio(F.col("tp"), F.col("n_pos")),
        "fpr": ratio(F.col("fp"), F.col("n_neg")),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
    })


def pr_curve(df: DataFrame, groups: Sequence[str] = (), **columns: str) -> DataFrame:
    """Precision, recall and threshold per distinct score, and the closing point (1, 0) without threshold."""
    curve = score_curve(df, groups, **columns)
    point = F.struct("threshold", "precision", F.col("tpr").alias("recall"))
    closing = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                       F.lit(0.0).alias("recall"))
    return curve.select(*groups, F.inline(F.when(is_last(), F.array(point, closing)).otherwise(F.array(point))))


def is_first() -> Column:
    """True on the highest score of a curve."""
    return (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))


def is_last() -> Column:
    """True on the lowest score of a curve."""
    return (F.col("tp") == F.col("n_pos")) & (F.col("fp") == F.col("n_neg"))


def roc_curve(df: DataFrame, groups: Sequence[str] = (), drop_intermediate: bool = False,
              **columns: str) -> DataFrame:
    """FPR, TPR and threshold per distinct score, starting from (0, 0) at +inf.

    ``drop_intermediate`` leaves out a point whose step equals the step after it.
    """
    curve = score_curve(df, groups, look_ahead=drop_intermediate, **columns)
    if drop_intermediate:
        turns = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
        curve = curve.where(is_first() | is_last() | turns)
    point = F.struct("threshold", "fpr", "tpr")
    opening = F.struct(F.lit(INF).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.select(*groups, F.inline(F.when(is_first(), F.array(opening, point)).otherwise(F.array(point))))


def average_precision() -> Column:
    """Step-wise average precision as an aggregate over a score curve: 0 without positives."""
    gained = F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.max("n_pos"), F.lit(0))
    return F.when(F.max("n_pos").isNotNull(), F.coalesce(gained, F.lit(0.0)))


def roc_auc() -> Column:
    """Tie-aware area under the ROC curve as an aggregate over a score curve: null with one class."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return ratio(area, F.max("n_pos").cast("double") * F.max("n_neg"))


def fpr_point(target: float) -> Column:
    """Struct (threshold, fpr, tpr) of the first curve point whose TPR reaches ``target``, null if none does.

    FPR and TPR grow along the curve, so each part is a plain minimum or maximum; plain numbers keep the
    aggregation hash-based.
    """
    reached = F.col("tpr") >= F.lit(float(target))
    return F.struct(F.max(F.when(reached, F.col("threshold"))).alias("threshold"),
                    F.min(F.when(reached, F.col("fpr"))).alias("fpr"), F.min(F.when(reached, F.col("tpr"))).alias("tpr"))


def tpr_point(budget: float) -> Column:
    """Struct (tpr, threshold) of the largest TPR with FPR within ``budget``, at its highest threshold.

    That is the last point within the budget that adds positives. If there is none, TPR is 0 at threshold
    +inf, the start of the curve; without negatives both are null.
    """
    within = (F.col("fpr") <= F.lit(float(budget))) & (F.col("pos") > 0) & (F.col("tpr") > 0)
    some = F.max("fpr").isNotNull()
    return F.struct(F.coalesce(F.max(F.when(within, F.col("tpr"))), F.when(some, F.lit(0.0))).alias("tpr"),
                    F.coalesce(F.min(F.when(within, F.col("threshold"))), F.when(some, F.lit(INF))).alias("threshold"))


def summary(curve: DataFrame, groups: Sequence[str] = (), targets: Sequence[float] = (0.95,),
            budgets: Sequence[float] = ()) -> DataFrame:
    """All curve metrics of every group in one partially aggregated pass over a score curve."""
    def tag(x: float) -> str:
        """The decimals of a share, two at least: ``95``, ``01``, ``001``; and ``100`` for all."""
        return "100" if x == 1 else f"{x:.10f}".rstrip("0").partition(".")[2].ljust(2, "0")

    picked = curve.groupBy(*groups).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        average_precision().alias("pr_auc"), roc_auc().alias("roc_auc"),
        *[fpr_point(t).alias(f"__f{tag(t)}") for t in targets],
        *[tpr_point(b).alias(f"__t{tag(b)}") for b in budgets])
    out = [*groups, "n_pos", "n_neg", "pr_auc", "roc_auc"]
    for t in targets:
        out += [F.col(f"__f{tag(t)}.fpr").alias(f"fpr_at_tpr{tag(t)}"),
                F.col(f"__f{tag(t)}.threshold").alias(f"thr_at_tpr{tag(t)}")]
    for b in budgets:
        out += [F.col(f"__t{tag(b)}.tpr").alias(f"tpr_at_fpr{tag(b)}"),
                F.col(f"__t{tag(b)}.threshold").alias(f"thr_at_fpr{tag(b)}")]
    return picked.select(*out)


def operating_points(curve: DataFrame, groups: Sequence[str] = (), targets: Sequence[float] = (),
                     budgets: Sequence[float] = ()) -> DataFrame:
    """Long form of the operating points: ``kind``, ``bound``, ``fpr``, ``tpr``, ``threshold``."""
    at_target = [F.struct(F.lit("fpr_at_tpr").alias("kind"), F.lit(float(t)).alias("bound"),
                          fpr_point(t)["fpr"].alias("value"), fpr_point(t)["threshold"].alias("threshold"))
                 for t in targets]
    at_budget = [F.struct(F.lit("tpr_at_fpr").alias("kind"), F.lit(float(b)).alias("bound"),
                          tpr_point(b)["tpr"].alias("value"), tpr_point(b)["threshold"].alias("threshold"))
                 for b in budgets]
    found = curve.groupBy(*groups).agg(F.array(*at_target, *at_budget).alias("__points"))
    return found.select(*groups, F.inline("__points"))


# --- decisions at a threshold -------------------------------------------------------------------------

def confusion(df: DataFrame, groups: Sequence[str] = (), label: str = "y_true", predicted: str = "y_pred",
              weight: str | None = None) -> DataFrame:
    """``tn, fp, fn, tp`` with zero cells kept."""
    amount = F.col(weight) if weight else F.lit(1)

    def cell(t: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col(label) == t) & (F.col(predicted) == p), amount)), F.lit(0))

    return df.groupBy(*groups).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                   cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def cell_precision(epsilon: float = 0.0) -> Column:
    return or_zero(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.lit(epsilon)))


def cell_recall(epsilon: float = 0.0) -> Column:
    return or_zero(ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.lit(epsilon)))


def harmonic(p: Column, r: Column, epsilon: float = 0.0) -> Column:
    return or_zero(ratio(2.0 * p * r, p + r + F.lit(epsilon)))


def with_rates(cells: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """Accuracy, precision, recall, F1 and FPR from confusion cells; a zero divisor gives 0."""
    return cells.withColumns({
        "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        "precision": cell_precision(epsilon),
        "recall": cell_recall(epsilon),
        "f1": (or_zero(ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))) if epsilon == 0
               else harmonic(cell_precision(epsilon), cell_recall(epsilon), epsilon)),
    })


def realised_rates(cells: DataFrame, zero_safe: bool = False) -> DataFrame:
    """Realised FPR and TPR of confusion cells: null without the class, or 0 if ``zero_safe``."""
    fpr = ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    tpr = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cells.withColumns({"fpr": or_zero(fpr) if zero_safe else fpr, "tpr": or_zero(tpr) if zero_safe else tpr})


def accuracy(df: DataFrame, groups: Sequence[str] = (), label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"))


def base_rate(df: DataFrame, groups: Sequence[str] = (), label: str = "y_true") -> DataFrame:
    """Row count and share of positives."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("pos_rate"))


def mean_scores(df: DataFrame, groups: Sequence[str] = (), score: str = "y_score", label: str = "y_true") -> DataFrame:
    """Mean score of the positives and of the negatives."""
    return df.groupBy(*groups).agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("mean_score_pos"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("mean_score_neg"))


# --- several classes ----------------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Counts for every pair of labels seen on either side, 0 where a pair does not occur.

    The counted pairs are few; the empty cells are added by exploding the sorted label list over them.
    """
    pairs = df.groupBy(F.col(label).cast("string").alias("actual"),
                       F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    names = pairs.select(F.explode(F.array("actual", "predicted")).alias("name")).where("name is not null").distinct()
    listed = names.agg(F.sort_array(F.collect_list("name")).alias("names")).scalar()
    empty = (names.withColumn("predicted", F.explode(listed))
             .select(F.col("name").alias("actual"), "predicted", F.lit(0).cast("bigint").alias("n")))
    return pairs.unionByName(empty).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def classification_report(df: DataFrame, label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and macro and weighted means."""
    pairs = df.groupBy(F.col(label).cast("string").alias("actual"),
                       F.col(predicted).cast("string").alias("guess")).agg(F.count(F.lit(1)).alias("n"))
    per_class = (pairs.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("guess").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hits")))))
        .groupBy("class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"),
                              F.sum("hits").alias("hits"))
        .withColumns({"precision": or_zero(ratio(F.col("hits"), F.col("guessed"))),
                      "recall": or_zero(ratio(F.col("hits"), F.col("support")))})
        .withColumn("f1", or_zero(ratio(2.0 * F.col("hits"), F.col("guessed") + F.col("support")))))
    share = F.col("support") / F.lit(1.0)
    means = per_class.agg(
        F.sum("support").alias("total"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[ratio(F.sum(F.col(m) * share), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])
    nothing = F.lit(None).cast("double")
    lines = means.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), nothing.alias("precision"), nothing.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("total").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("macro_precision").alias("precision"),
                 F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), F.col("total").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("weighted_precision").alias("precision"),
                 F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"),
                 F.col("total").alias("support")))))
    return per_class.select("class", "precision", "recall", "f1", "support").unionByName(lines)


# --- grids of thresholds ------------------------------------------------------------------------------

def quantile_grid(curve: DataFrame, parts: int, groups: Sequence[str] = ()) -> DataFrame:
    """Score quantiles at 0/parts…parts/parts with the counts of scoring at or above each.

    The grid is read off the curve itself, so testing 2,001 thresholds costs no further pass over the rows.
    """
    n = F.col("n_pos") + F.col("n_neg")
    below = n - F.col("tp") - F.col("fp")
    return grid_points(curve, groups, "threshold", below, F.col("pos") + F.col("neg"), n, parts,
                       carry=["tp", "fp", "n_pos", "n_neg"])


def threshold_sweep(curve: DataFrame, parts: int = 2000, groups: Sequence[str] = ()) -> DataFrame:
    """FPR and TPR at every distinct score quantile; 0 without the class."""
    grid = quantile_grid(curve, parts, groups)
    return grid.groupBy(*groups, F.col("quantile").alias("threshold")).agg(
        F.max(or_zero(ratio(F.col("fp"), F.col("n_neg")))).alias("fpr"),
        F.max(or_zero(ratio(F.col("tp"), F.col("n_pos")))).alias("tpr"))


def alarms(score: Column, threshold: Column) -> Column:
    """1 at or above the threshold. A score that is no number raises no alarm; a missing one stays null."""
    return ((score >= threshold) & ~F.isnan(score.cast("double"))).cast("int")


def decide(df: DataFrame, thresholds: DataFrame, groups: Sequence[str] = (), score: str = "y_score",
           threshold: str = "threshold", predicted: str = "y_pred") -> DataFrame:
    """Rows with ``score >= threshold`` decided by fitted thresholds, one row of them per group."""
    table = fitted(thresholds) if groups else thresholds
    joined = attach(df.drop(predicted), table.select(*groups, threshold), groups)
    return joined.withColumn(predicted, F.coalesce(alarms(F.col(score), F.col(threshold)), F.lit(0)))
