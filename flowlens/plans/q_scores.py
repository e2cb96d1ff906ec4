"""Queries: metrics, thresholds, splits, slices and bootstrap of scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.cleaning import sigmoid
from flowlens.functions.relational import attach
from flowlens.operators import bootstrap as B
from flowlens.operators import cleaning, labels
from flowlens.operators import metrics as M
from flowlens.operators import slices as SL
from flowlens.operators import splits as SP
from flowlens.operators import thresholds as TH
from flowlens.plans import views as V
from flowlens.plans.registry import query, rounded
from flowlens.plans.views import SQL_VIEWS
from flowlens.session import saved

GROUP_CURVE = f"group_curve AS ({SQL_VIEWS['group_curve']})"
AP = "coalesce(sum(pos * precision) / nullif(max(n_pos), 0), 0)"
AUC = "sum(neg * (tp - pos / 2.0e0)) / nullif(max(n_pos)::DOUBLE * max(n_neg), 0)"
CELLS = """CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS BIGINT) AS tp"""


def finite_threshold(df, column: str = "threshold"):
    """The check compares finite numbers; +inf thresholds are shown as null."""
    return df.withColumn(column, F.when(F.col(column) != F.lit(float("inf")), F.col(column)))


# --- metrics ------------------------------------------------------------------------------------------

@query("mt_1_confusion", f"SELECT profile, {CELLS} FROM scored GROUP BY profile", "scored")
def _(spark, d):
    return M.confusion(V.scored(spark, d), ["profile"])


@query("mt_2_confusion_matrix", """, names AS (SELECT y_true AS x FROM multiclass UNION SELECT y_pred FROM multiclass)
SELECT a.x AS actual, b.x AS predicted, CAST(count(m.y_true) AS BIGINT) AS n
FROM names a CROSS JOIN names b LEFT JOIN multiclass m ON m.y_true = a.x AND m.y_pred = b.x GROUP BY 1, 2""",
       "multiclass")
def _(spark, d):
    return M.confusion_matrix(V.multiclass(spark, d))


@query("mt_3_accuracy", """SELECT profile, round(avg(CASE WHEN y_true = y_pred THEN 1.0e0 ELSE 0 END), 6) AS accuracy
FROM scored GROUP BY profile""", "scored")
def _(spark, d):
    return rounded(M.accuracy(V.scored(spark, d), ["profile"]))


@query("mt_4_precision_recall_f1", f""", c AS (SELECT attack_type, {CELLS} FROM scored GROUP BY attack_type)
SELECT attack_type, tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2.0e0 * tp / nullif(2.0e0 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""", "scored")
def _(spark, d):
    return rounded(M.with_rates(M.confusion(V.scored(spark, d), ["attack_type"])))


@query("mt_5_classification_report", """, names AS (SELECT y_true AS x FROM multiclass UNION SELECT y_pred FROM multiclass),
c AS (SELECT x, (SELECT count(*) FROM multiclass WHERE y_true = x) AS support,
  (SELECT count(*) FROM multiclass WHERE y_pred = x) AS guessed,
  (SELECT count(*) FROM multiclass WHERE y_true = x AND y_pred = x) AS hits FROM names),
r AS (SELECT x AS class, coalesce(hits / nullif(guessed, 0)::DOUBLE, 0) AS precision,
  coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
  coalesce(2.0e0 * hits / nullif(guessed + support, 0), 0) AS f1, CAST(support AS BIGINT) AS support, hits FROM c),
u AS (SELECT class, precision, recall, f1, support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support)::DOUBLE, sum(recall * support) / sum(support)::DOUBLE,
  sum(f1 * support) / sum(support)::DOUBLE, CAST(sum(support) AS BIGINT) FROM r)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""",
       "multiclass")
def _(spark, d):
    return rounded(M.classification_report(V.multiclass(spark, d)))


@query("mt_6_pr_curve", """SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(tpr, 6) AS recall
FROM curve UNION ALL SELECT NULL, 1.0e0, 0.0e0""", "scored curve")
def _(spark, d):
    return rounded(M.pr_curve(V.scored(spark, d)))


@query("mt_7_average_precision", f""", grouped AS (SELECT *, profile AS g FROM scored), {GROUP_CURVE}
SELECT g AS profile, round({AP}, 6) AS pr_auc FROM group_curve GROUP BY g""", "scored")
def _(spark, d):
    curve = M.score_curve(V.scored(spark, d), ["profile"])
    return rounded(M.summary(curve, ["profile"]).select("profile", "pr_auc"))


@query("mt_7_average_precision_fine", f"SELECT round({AP}, 6) AS pr_auc FROM curve", "scored_fine curve")
def _(spark, d):
    return rounded(M.summary(M.score_curve(V.scored_fine(spark, d))).select("pr_auc"))


@query("mt_8_roc_curve", """SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve
UNION ALL SELECT NULL, 0.0e0, 0.0e0""", "scored curve")
def _(spark, d):
    return rounded(finite_threshold(M.roc_curve(V.scored(spark, d))))


@query("mt_8_roc_corners", """, steps AS (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
  row_number() OVER w AS i FROM curve WINDOW w AS (ORDER BY threshold DESC))
SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM steps
WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT NULL, 0.0e0, 0.0e0""",
       "scored_fine curve")
def _(spark, d):
    return rounded(finite_threshold(M.roc_curve(V.scored_fine(spark, d), drop_intermediate=True)))


@query("mt_9_roc_auc", f""", grouped AS (SELECT *, attack_type AS g FROM scored
  UNION ALL SELECT *, profile AS g FROM scored), {GROUP_CURVE}
SELECT g AS slice, round({AUC}, 6) AS roc_auc FROM group_curve GROUP BY g""", "scored")
def _(spark, d):
    rows = V.scored(spark, d).withColumn("slice", F.explode(F.array("attack_type", "profile")))
    return rounded(M.summary(M.score_curve(rows, ["slice"]), ["slice"]).select("slice", "roc_auc"))


@query("mt_10_fpr_at_tpr", """SELECT b AS bound, round(arg_max(fpr, threshold), 6) AS value, round(max(threshold), 6) AS threshold
FROM curve, (VALUES (0.9e0), (0.95e0), (0.99e0)) t(b) WHERE tpr >= b GROUP BY b""", "scored_fine curve")
def _(spark, d):
    curve = M.score_curve(V.scored_fine(spark, d))
    return rounded(M.operating_points(curve, targets=[0.90, 0.95, 0.99]).drop("kind"))


@query("mt_11_tpr_at_fpr", """SELECT b AS bound, round(tpr, 6) AS value, round(threshold, 6) AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY tpr DESC, threshold DESC) AS i
  FROM curve, (VALUES (0.001e0), (0.01e0), (0.05e0), (0.1e0)) t(b) WHERE fpr <= b) WHERE i = 1""", "scored_fine curve")
def _(spark, d):
    curve = M.score_curve(V.scored_fine(spark, d))
    return rounded(M.operating_points(curve, budgets=[0.001, 0.01, 0.05, 0.10]).drop("kind"))


@query("mt_12_base_rate", """SELECT profile, CAST(count(*) AS BIGINT) AS n, round(avg(y_true), 6) AS pos_rate
FROM scored GROUP BY profile""", "scored")
def _(spark, d):
    return rounded(M.base_rate(V.scored(spark, d), ["profile"]))


@query("mt_13_mean_scores", """SELECT attack_type, round(avg(y_score) FILTER (WHERE y_true = 1), 6) AS mean_score_pos,
  round(avg(y_score) FILTER (WHERE y_true = 0), 6) AS mean_score_neg FROM scored GROUP BY attack_type""", "scored")
def _(spark, d):
    return rounded(M.mean_scores(V.scored(spark, d), ["attack_type"]))


def grid_sql(view: str, parts: int) -> str:
    """Score quantiles at j/parts by row number."""
    return f"""sorted AS (SELECT y_score AS s, row_number() OVER (ORDER BY y_score) - 1 AS rn FROM {view}),
places AS (SELECT j, ((n - 1) * j) // {parts} AS lo, ((n - 1) * j) % {parts} AS rest
  FROM range(0, {parts + 1}) t(j), (SELECT count(*) AS n FROM {view})),
grid AS (SELECT j, a.s + (b.s - a.s) * (rest / {parts}.0e0) AS q FROM places
  JOIN sorted a ON a.rn = lo JOIN sorted b ON b.rn = lo + CASE WHEN rest > 0 THEN 1 ELSE 0 END),
grid_counts AS (SELECT j, q, max(tp) AS tp, max(fp) AS fp, max(n_pos) AS n_pos, max(n_neg) AS n_neg
  FROM grid JOIN curve ON threshold >= q GROUP BY j, q)"""


@query("mt_14_threshold_sweep", f""", {grid_sql('scored', 2000)}
SELECT DISTINCT round(q, 9) AS threshold, round(coalesce(fp / nullif(n_neg, 0)::DOUBLE, 0), 6) AS fpr,
  round(coalesce(tp / nullif(n_pos, 0)::DOUBLE, 0), 6) AS tpr FROM (SELECT DISTINCT q, tp, fp, n_pos, n_neg FROM grid_counts)""",
       "scored curve")
def _(spark, d):
    swept = M.threshold_sweep(M.score_curve(V.scored(spark, d)))
    return swept.select(F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("mt_15_realised_rates", f""", c AS (SELECT attack_type, {CELLS} FROM scored GROUP BY attack_type)
SELECT attack_type, tn, fp, fn, tp, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr,
  round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS tpr FROM c""", "scored")
def _(spark, d):
    return rounded(M.realised_rates(M.confusion(V.scored(spark, d), ["attack_type"])))


@query("mt_curve_weighted", """, w AS (SELECT y_score, y_true, 1 + CAST(round(y_score * 1000) AS BIGINT) % 3 AS w FROM scored),
s AS (SELECT y_score, sum(w * y_true) AS pos, sum(w * (1 - y_true)) AS neg FROM w GROUP BY y_score),
c AS (SELECT *, sum(pos) OVER (ORDER BY y_score DESC) AS tp, sum(neg) OVER (ORDER BY y_score DESC) AS fp FROM s)
SELECT round(sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos)::DOUBLE, 6) AS pr_auc, CAST(sum(pos) AS BIGINT) AS n_pos,
  CAST(sum(neg) AS BIGINT) AS n_neg FROM c""", "scored")
def _(spark, d):
    rows = V.scored(spark, d).withColumn("w", 1 + F.round(F.col("y_score") * 1000).cast("bigint") % 3)
    return rounded(M.summary(M.score_curve(rows, weight="w")).select("pr_auc", "n_pos", "n_neg"))


# --- thresholds ---------------------------------------------------------------------------------------

@query("th_1_fixed_decision", """SELECT y_true, CASE WHEN y_score >= 0.5e0 THEN 1 ELSE 0 END AS y_pred, CAST(count(*) AS BIGINT) AS n
FROM scored_fine GROUP BY 1, 2""", "scored_fine")
def _(spark, d):
    return (TH.fixed_decision(V.scored_fine(spark, d)).groupBy("y_true", "y_pred")
            .agg(F.count(F.lit(1)).alias("n")))


@query("th_2_best_f1_curve", """, f AS (SELECT threshold, 2.0e0 * precision * tpr / (precision + tpr + 1e-12) AS f1 FROM curve)
SELECT round(threshold, 9) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""",
       "scored curve")
def _(spark, d):
    found = TH.best_f1_on_curve(M.score_curve(V.scored(spark, d)))
    return found.select(F.round("threshold", 9).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("th_3_threshold_at_tpr", """SELECT round(max(threshold), 6) AS threshold, round(arg_max(tpr, threshold), 6) AS tpr
FROM curve WHERE tpr >= 0.95e0""", "scored curve")
def _(spark, d):
    return rounded(TH.at_tpr(M.score_curve(V.scored(spark, d)), 0.95))


@query("th_4_threshold_at_fpr", """SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr FROM curve
WHERE fpr <= 0.05e0 ORDER BY curve.tpr DESC, curve.threshold DESC LIMIT 1""", "scored_fine curve")
def _(spark, d):
    return rounded(TH.at_fpr(M.score_curve(V.scored_fine(spark, d)), 0.05))


@query("th_5_best_f1_grid", f""", {grid_sql('scored_fine', 2000)},
f AS (SELECT j, q, coalesce(2.0e0 * tp / nullif(tp + fp + n_pos, 0), 0) AS f1, tp, fp, n_pos FROM grid_counts)
SELECT round(q, 9) AS threshold, round(f1, 6) AS f1, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
  round(tp / n_pos::DOUBLE, 6) AS recall FROM f ORDER BY f.f1 DESC, j LIMIT 1""", "scored_fine curve")
def _(spark, d):
    best = TH.best_f1_on_grid(M.score_curve(V.scored_fine(spark, d)))
    return best.select(
        F.round("threshold", 9).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


KTH_SQL = """negatives AS (SELECT y_score AS s, row_number() OVER (ORDER BY y_score DESC) AS i, count(*) OVER () AS n
  FROM {rows} WHERE y_true = 0),
kth AS (SELECT b AS budget, coalesce(max(s) FILTER (WHERE i = CAST(floor(b * n) AS BIGINT)), max(s) + 1e-12) AS threshold
  FROM negatives, (VALUES {budgets}) t(b) GROUP BY b)"""


@query("th_6_kth_negative_threshold", ", " + KTH_SQL.format(
    rows="scored_fine", budgets="(0.000001e0), (0.01e0), (0.05e0), (0.34e0)") + """
SELECT budget, round(threshold, 9) AS threshold FROM kth""", "scored_fine")
def _(spark, d):
    found = TH.kth_negative_thresholds(M.score_curve(V.scored_fine(spark, d)), [0.000001, 0.01, 0.05, 0.34])
    return found.select("budget", F.round("threshold", 9).alias("threshold"))


def split_sql(name: str, view: str, test: str, rest: str | None = None, strata: str = "y_true", key: str = "row_id",
              names: tuple[str, ...] = ("test", "val", "train")) -> str:
    """Exact splits by md5 rank: ``test`` and ``rest`` give the last rank of the first and second part."""
    part = f"PARTITION BY {strata}" if strata else ""
    second = f"WHEN i <= {rest} THEN '{names[1]}' " if rest else ""
    return f"""{name} AS (SELECT * EXCLUDE (i, n), CASE WHEN i <= {test} THEN '{names[0]}' {second}ELSE '{names[-1]}' END AS split FROM (
  SELECT *, row_number() OVER ({part} ORDER BY md5('7:' || {key}), {key}) AS i, count(*) OVER ({part}) AS n FROM {view}))"""


N_TEST = "ceil(0.3e0 * n)"
BUDGET_SPLIT = split_sql("parts", "scored_fine", N_TEST, f"({N_TEST} + ceil(0.25e0 * (n - {N_TEST})))")


def curve_sql(name: str, rows: str) -> str:
    return f"{name} AS ({SQL_VIEWS['curve'].replace('{first}', rows)})"


BUDGET_FIT = f"""{BUDGET_SPLIT}, val AS (SELECT * FROM parts WHERE split = 'val'),
test AS (SELECT * FROM parts WHERE split = 'test'), {curve_sql('val_curve', 'val')}"""


def budget_parts(spark, d):
    """The split scores, written once: every curve and count after it is a plain scan."""
    rows = V.scored_fine(spark, d).select("row_id", "y_true", "y_score")
    return saved(SP.train_val_test(rows, 0.30, 0.25, ["y_true"]))


@query("th_7_curve_budget_on_test", f""", {BUDGET_FIT},
fit AS (SELECT b AS budget, arg_max(threshold, tpr * 1e6 + threshold) AS threshold FROM val_curve,
  (VALUES (0.01e0), (0.05e0)) t(b) WHERE fpr <= b AND tpr > 0 GROUP BY b)
SELECT budget, round(threshold, 9) AS threshold, CAST(count(*) FILTER (WHERE y_score >= threshold) AS BIGINT) AS alarms,
  round(count(*) FILTER (WHERE y_score >= threshold AND y_true = 0) / count(*) FILTER (WHERE y_true = 0)::DOUBLE, 6) AS fpr,
  round(count(*) FILTER (WHERE y_score >= threshold AND y_true = 1) / count(*) FILTER (WHERE y_true = 1)::DOUBLE, 6) AS tpr
FROM test, fit GROUP BY budget, threshold""", "scored_fine")
def _(spark, d):
    parts = budget_parts(spark, d)
    fit = TH.curve_budget(M.score_curve(parts.where("split = 'val'")), [0.01, 0.05])
    return _realised(parts.where("split = 'test'"), fit)


def _realised(test, fit):
    """Alarms and realised rates of the test rows at each fitted budget, in one pass over them."""
    counts = TH.counts_at(test, fit, "budget")
    return counts.select("budget", F.round("threshold", 9).alias("threshold"), (F.col("tp") + F.col("fp")).alias("alarms"),
                         F.round(F.col("fp") / F.col("n_neg"), 6).alias("fpr"),
                         F.round(F.col("tp") / F.col("n_pos"), 6).alias("tpr"))


@query("th_8_first_within_budget", """SELECT b AS budget, round(max(threshold) FILTER (WHERE fpr <= b), 9) AS threshold
FROM curve, (VALUES (0.001e0), (0.01e0), (0.05e0)) t(b) GROUP BY b""", "scored_fine curve")
def _(spark, d):
    found = finite_threshold(TH.first_within_budget(M.score_curve(V.scored_fine(spark, d)), [0.001, 0.01, 0.05]))
    return found.select("budget", F.round("threshold", 9).alias("threshold"))


FEW_SHOT_SQL = """, coefs AS (SELECT row_id, y_true, y_score,
  list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(md5('7:' || row_id), 1 + 8 * i, 8))::BIGINT % 2147483647) AS c FROM scored),
drawn AS (SELECT rep, row_id, y_true, y_score,
  (((((c[4] * rep + c[3]) % 2147483647) * rep + c[2]) % 2147483647) * rep + c[1]) % 2147483647 AS u
  FROM coefs, range(1, 51) t(rep)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY u, row_id) AS i FROM drawn),
cal AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY y_score) - 1 AS rn, count(*) OVER (PARTITION BY rep) AS n,
  sum(y_true) OVER (PARTITION BY rep) AS n_pos FROM ranked WHERE i <= 500),
places AS (SELECT rep, j, ((n - 1) * j) // 1000 AS lo, ((n - 1) * j) % 1000 AS rest
  FROM (SELECT DISTINCT rep, n FROM cal), range(0, 1001) t(j)),
grid AS (SELECT p.rep, j, a.y_score + (b.y_score - a.y_score) * (rest / 1000.0e0) AS q FROM places p
  JOIN cal a ON a.rep = p.rep AND a.rn = lo JOIN cal b ON b.rep = p.rep AND b.rn = lo + CASE WHEN rest > 0 THEN 1 ELSE 0 END),
tried AS (SELECT g.rep, g.q, min(j) AS j, 2.0e0 * sum(y_true) / (count(*) + max(n_pos)) AS f1
  FROM (SELECT rep, q, min(j) AS j FROM grid GROUP BY rep, q) g JOIN cal ON cal.rep = g.rep AND cal.y_score >= g.q GROUP BY g.rep, g.q),
chosen AS (SELECT rep, q AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY f1 DESC, j) AS k FROM tried) WHERE k = 1),
cells AS (SELECT rep, threshold, count(*) FILTER (WHERE y_true = 1 AND y_score >= threshold) AS tp,
  count(*) FILTER (WHERE y_true = 0 AND y_score >= threshold) AS fp, count(*) FILTER (WHERE y_true = 1 AND y_score < threshold) AS fn
  FROM ranked JOIN chosen USING (rep) WHERE i > 500 GROUP BY rep, threshold),
results AS (SELECT rep, threshold, coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM cells)
"""


@query("th_9_few_shot", FEW_SHOT_SQL + """SELECT CAST(rep AS INTEGER) AS rep, round(threshold, 9) AS threshold, round(f1, 6) AS f1,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM results""", "scored")
def _(spark, d):
    found = TH.few_shot(V.scored(spark, d), k=500, reps=50)
    return found.select("rep", F.round("threshold", 9).alias("threshold"),
                        *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")])


@query("th_9_few_shot_summary", FEW_SHOT_SQL + """SELECT CAST(count(*) AS BIGINT) AS reps, round(avg(f1), 6) AS f1_mean,
  round(stddev_pop(f1), 6) AS f1_std, round(avg(precision), 6) AS precision_mean, round(stddev_pop(precision), 6) AS precision_std,
  round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std FROM results""", "scored")
def _(spark, d):
    return rounded(TH.few_shot_summary(TH.few_shot(V.scored(spark, d), k=500, reps=50)))


FLIPPED_CURVE = """down AS (SELECT y_score, pos, pos_up / (pos_up + neg_up)::DOUBLE AS precision, n_pos FROM (
  SELECT *, sum(pos) OVER (ORDER BY y_score) AS pos_up, sum(neg) OVER (ORDER BY y_score) AS neg_up, sum(pos) OVER () AS n_pos
  FROM (SELECT y_score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {rows} GROUP BY y_score)))"""


@query("th_10_orientation", f""", {FLIPPED_CURVE.format(rows='scored_fine')},
a AS (SELECT {AP} AS ap FROM curve), b AS (SELECT sum(pos * precision) / max(n_pos)::DOUBLE AS ap_flipped FROM down)
SELECT round(ap, 6) AS ap, round(ap_flipped, 6) AS ap_flipped, ap_flipped > ap AS flip FROM a, b""", "scored_fine curve")
def _(spark, d):
    return rounded(TH.orientation(V.scored_fine(spark, d)))


@query("th_11_flipped", """SELECT row_id, y_true, round(1.0e0 - y_score, 9) AS y_score,
  CASE WHEN 1.0e0 - y_score >= 0.5e0 THEN 1 ELSE 0 END AS y_pred FROM scored""", "scored")
def _(spark, d):
    return TH.flipped(V.scored(spark, d)).select("row_id", "y_true", F.round("y_score", 9).alias("y_score"), "y_pred")


SINGLE_SHOT = split_sql("parts", "scored_fine", "CAST(floor(0.2e0 * n) AS BIGINT)", strata="", names=("calib", "test"))


@query("th_12_single_shot", f""", {SINGLE_SHOT}, calib AS (SELECT * FROM parts WHERE split = 'calib'),
{curve_sql('calib_curve', 'calib')}, {FLIPPED_CURVE.format(rows='calib')},
facing AS (SELECT (SELECT {AP} FROM calib_curve) AS ap, (SELECT sum(pos * precision) / max(n_pos)::DOUBLE FROM down) AS ap_flipped),
turned AS (SELECT row_id, y_true, split, CASE WHEN ap_flipped > ap THEN 1.0e0 - y_score ELSE y_score END AS y_score FROM parts, facing),
c2 AS (SELECT * FROM turned WHERE split = 'calib'), test AS (SELECT * FROM turned WHERE split = 'test'),
{KTH_SQL.format(rows='c2', budgets='(0.01e0), (0.05e0)')},
{curve_sql('test_curve', 'test')},
lim AS (SELECT max(threshold) FILTER (WHERE budget = 0.01e0) AS t01, max(threshold) FILTER (WHERE budget = 0.05e0) AS t05 FROM kth),
got AS (SELECT count(*) AS n_test, avg(CASE WHEN y_true = (y_score >= 0.5e0)::INT THEN 1.0e0 ELSE 0 END) AS accuracy,
  count(*) FILTER (WHERE y_true = 1 AND y_score >= t01) / count(*) FILTER (WHERE y_true = 1)::DOUBLE AS tpr01,
  count(*) FILTER (WHERE y_true = 0 AND y_score >= t01) / count(*) FILTER (WHERE y_true = 0)::DOUBLE AS fpr01,
  count(*) FILTER (WHERE y_true = 1 AND y_score >= t05) / count(*) FILTER (WHERE y_true = 1)::DOUBLE AS tpr05,
  count(*) FILTER (WHERE y_true = 0 AND y_score >= t05) / count(*) FILTER (WHERE y_true = 0)::DOUBLE AS fpr05 FROM test, lim)
SELECT CAST(n_test AS BIGINT) AS n_test, ap_flipped > ap AS flip, round((SELECT {AP} FROM test_curve), 6) AS pr_auc,
  round((SELECT arg_max(fpr, threshold) FROM test_curve WHERE tpr >= 0.95e0), 6) AS fpr95, round(accuracy, 6) AS accuracy,
  round(tpr01, 6) AS tpr01, round(fpr01, 6) AS fpr01, round(tpr05, 6) AS tpr05, round(fpr05, 6) AS fpr05 FROM facing, got""",
       "scored_fine")
def _(spark, d):
    fit, test = TH.single_shot(V.scored_fine(spark, d))
    pos, neg = F.col("y_true") == 1, F.col("y_true") == 0
    got = test.agg(
        F.count(F.lit(1)).alias("n_test"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"),
        *[F.avg(F.when(side, F.col(f"y_pred_fpr{b}"))).alias(f"{name}{b}")
          for b in ("01", "05") for name, side in (("tpr", pos), ("fpr", neg))])
    curve = M.summary(M.score_curve(test)).select("pr_auc", F.col("fpr_at_tpr95").alias("fpr95"))
    return rounded(attach(attach(got, curve, []), fit.select("flip"), []))


@query("th_13_budget_predictions", f""", {BUDGET_FIT},
fit AS (SELECT b AS budget, max(threshold) FILTER (WHERE fpr <= b) AS threshold FROM val_curve,
  (VALUES (0.01e0), (0.05e0)) t(b) GROUP BY b),
one AS (SELECT max(threshold) FILTER (WHERE budget = 0.01e0) AS t01, max(threshold) FILTER (WHERE budget = 0.05e0) AS t05 FROM fit)
SELECT row_id, y_true, round(y_score, 9) AS y_score, coalesce((y_score >= t01)::INT, 0) AS y_pred_fpr01,
  coalesce((y_score >= t05)::INT, 0) AS y_pred_fpr05 FROM test, one""", "scored_fine")
def _(spark, d):
    parts = budget_parts(spark, d)
    fit = TH.first_within_budget(M.score_curve(parts.where("split = 'val'")), [0.01, 0.05])
    rows = parts.where("split = 'test'").select("row_id", "y_true", "y_score")
    for name, budget in (("y_pred_fpr01", 0.01), ("y_pred_fpr05", 0.05)):
        one = fit.where(F.col("budget") == budget).agg(F.max("threshold").alias("threshold"))
        rows = M.decide(rows, one, predicted=name).drop("threshold")
    return rows.withColumn("y_score", F.round("y_score", 9))


@query("th_14_evaluation_block", f""", {BUDGET_FIT}, {curve_sql('test_curve', 'test')},
{KTH_SQL.format(rows='val', budgets='(0.01e0), (0.05e0)')},
named AS (SELECT 'default0.5' AS name, 0.5e0 AS t UNION ALL SELECT CASE WHEN budget = 0.01e0 THEN 'valFPR01' ELSE 'valFPR05' END, threshold FROM kth),
c AS (SELECT name, t, count(*) FILTER (WHERE y_true = 1 AND y_score >= t) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_score >= t) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_score < t) AS fn, count(*) FILTER (WHERE y_true = 0 AND y_score < t) AS tn
  FROM test, named GROUP BY name, t)
SELECT name, round(t, 6) AS threshold, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2.0e0 * tp / nullif(2.0e0 * tp + fp + fn, 0), 0), 6) AS f1, round(fp / greatest(1, fp + tn)::DOUBLE, 6) AS fpr,
  round((SELECT {AP} FROM test_curve), 6) AS pr_auc,
  round((SELECT arg_max(fpr, threshold) FROM test_curve WHERE tpr >= 0.95e0), 6) AS fpr95 FROM c""", "scored_fine")
def _(spark, d):
    parts = budget_parts(spark, d)
    limits = TH.kth_negative_thresholds(M.score_curve(parts.where("split = 'val'")), [0.01, 0.05])
    named = limits.select(F.when(F.col("budget") == 0.01, "valFPR01").otherwise("valFPR05").alias("name"), "threshold")
    default = spark.createDataFrame([("default0.5", 0.5)], "name string, threshold double")
    return rounded(TH.evaluation_block(parts.where("split = 'test'"), default.unionByName(named)))


# --- splits -------------------------------------------------------------------------------------------

def _sides(df):
    return df.select("row_id", "split")


@query("sp_2_stratified_split", f", {split_sql('parts', 'scored', 'ceil(0.2e0 * n)', names=('test', 'train'))} SELECT row_id, split FROM parts",
       "scored")
def _(spark, d):
    return _sides(SP.train_test(V.scored(spark, d), 0.2, ["y_true"]))


@query("sp_2_bernoulli_split", """SELECT row_id, CASE WHEN ('0x' || substr(md5('7:' || row_id), 1, 8))::BIGINT / 4294967296.0e0 < 0.2e0
  THEN 'test' ELSE 'train' END AS split FROM scored""", "scored")
def _(spark, d):
    return _sides(SP.bernoulli_split(V.scored(spark, d), 0.2))


@query("sp_3_split_60_20_20", ", " + split_sql("parts", "scored", "ceil(0.5e0 * ceil(0.4e0 * n))", "ceil(0.4e0 * n)")
       + " SELECT row_id, split FROM parts", "scored")
def _(spark, d):
    return _sides(SP.holdout_halves(V.scored(spark, d), strata=["y_true"]))


@query("sp_4_split_64_16_20", ", " + split_sql("parts", "scored", "ceil(0.2e0 * n)",
       "(ceil(0.2e0 * n) + ceil(0.2e0 * (n - ceil(0.2e0 * n))))") + " SELECT row_id, split FROM parts", "scored")
def _(spark, d):
    return _sides(SP.train_val_test(V.scored(spark, d), 0.2, 0.2, ["y_true"]))


@query("sp_5_budget_split", f", {BUDGET_SPLIT} SELECT row_id, split FROM parts", "scored_fine")
def _(spark, d):
    return _sides(SP.train_val_test(V.scored_fine(spark, d), 0.30, 0.25, ["y_true"]))


@query("sp_6_unstratified_split", ", " + split_sql("parts", "scored", "ceil(0.3e0 * n)", strata="", names=("test", "train"))
       + " SELECT row_id, split FROM parts", "scored")
def _(spark, d):
    return _sides(SP.train_test(V.scored(spark, d), 0.3))


@query("sp_7_group_split", """, g AS (SELECT iteration, row_number() OVER (ORDER BY md5('7:' || iteration), iteration) AS i,
  count(*) OVER () AS n FROM (SELECT DISTINCT iteration FROM group_rows))
SELECT row_id, iteration, CASE WHEN i <= ceil(0.3e0 * n) THEN 'test' ELSE 'train' END AS split FROM group_rows JOIN g USING (iteration)""",
       "group_rows")
def _(spark, d):
    return SP.group_split(V.group_rows(spark, d), "iteration").select("row_id", "iteration", "split")


@query("sp_8_calibration_split", f", {SINGLE_SHOT} SELECT row_id, split FROM parts", "scored_fine")
def _(spark, d):
    return _sides(SP.calibration_split(V.scored_fine(spark, d)))


@query("sp_9_calibration_samples", FEW_SHOT_SQL + "SELECT CAST(rep AS INTEGER) AS rep, row_id FROM cal", "scored")
def _(spark, d):
    return SP.calibration_samples(V.scored(spark, d), 500, 50).select("rep", "row_id")


@query("sp_10_subsample", """SELECT row_id, round(y_score, 6) AS y_score FROM scored ORDER BY md5('7:' || row_id), row_id LIMIT 1000""",
       "scored")
def _(spark, d):
    return rounded(SP.subsample(V.scored(spark, d), 1000).select("row_id", "y_score"))


@query("sp_1_day_split", """SELECT event_id, day, CASE WHEN day IN ('Tuesday', 'Wednesday') THEN 'train' WHEN day = 'Thursday' THEN 'val'
  ELSE 'test' END AS split FROM day_flows WHERE day IN ('Tuesday', 'Wednesday', 'Thursday', 'Friday')""", "day_flows")
def _(spark, d):
    return SP.day_split(V.day_flows(spark, d), **SP.DAY_PROTOCOLS["no_monday"]).select("event_id", "day", "split")


DAY_SCORES = """, rows AS (SELECT day, CASE WHEN upper(trim("Label")) <> 'BENIGN' THEN 1 ELSE 0 END AS y_true,
  (user_id % 50 * 20 + CASE WHEN event_type = 'error' THEN 300 ELSE 0 END) / 1300.0e0 AS y_score FROM day_flows)"""


def day_scores(spark, d):
    rows = labels.text_label(V.day_flows(spark, d))
    return rows.withColumn("y_score", (F.col("user_id") % 50 * 20 + F.when(F.col("event_type") == "error", 300).otherwise(0))
                           / F.lit(1300.0))


@query("sp_11_day_sweep", DAY_SCORES + f""", grouped AS (SELECT *, day AS g FROM rows), {GROUP_CURVE}
SELECT g AS day, g IN ('Tuesday', 'Wednesday') AS in_train, round({AP}, 6) AS pr_auc, round({AUC}, 6) AS roc_auc,
  round(arg_max(fpr, threshold) FILTER (WHERE tpr >= 0.95e0), 6) AS fpr95 FROM group_curve
WHERE g IN ('Tuesday', 'Wednesday', 'Thursday', 'Friday') GROUP BY g""", "day_flows")
def _(spark, d):
    rows = day_scores(spark, d).where(F.col("day").isin("Tuesday", "Wednesday", "Thursday", "Friday"))
    found = M.summary(M.score_curve(rows, ["day"]), ["day"])
    return rounded(found.select("day", F.col("day").isin("Tuesday", "Wednesday").alias("in_train"), "pr_auc", "roc_auc",
                                F.col("fpr_at_tpr95").alias("fpr95")))


# --- slices -------------------------------------------------------------------------------------------

@query("sl_1_with_truth", """SELECT row_id, round(p.y_score, 6) AS y_score, t.attack_type, t.y_true FROM preds p LEFT JOIN truth t USING (row_id)""",
       "truth preds")
def _(spark, d):
    return rounded(SL.with_truth(V.preds(spark, d), V.truth(spark, d)))


@query("sl_2_orphans", """SELECT doc_id AS row_id FROM documents WHERE doc_id NOT IN (SELECT row_id FROM truth)""", "truth")
def _(spark, d):
    every = V.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"))
    return SL.orphans(every, V.truth(spark, d))


SLICE = f"""round(avg_rate, 6) AS pos_rate, CASE WHEN n_pos > 0 THEN round(ap, 6) END AS pr_auc, round(auc, 6) AS roc_auc,
  round(mp, 6) AS mean_score_pos, round(mn, 6) AS mean_score_neg FROM (
  SELECT g, CAST(max(n_pos) + max(n_neg) AS BIGINT) AS n, max(n_pos) AS n_pos, max(n_pos) / (max(n_pos) + max(n_neg))::DOUBLE AS avg_rate,
    {AP} AS ap, {AUC} AS auc, sum(threshold * pos) / nullif(max(n_pos), 0)::DOUBLE AS mp,
    sum(threshold * neg) / nullif(max(n_neg), 0)::DOUBLE AS mn FROM group_curve GROUP BY g)"""


@query("sl_3_per_attack_type", f""", grouped AS (SELECT t.attack_type AS g, t.y_true, p.y_score FROM preds p JOIN truth t USING (row_id)),
{GROUP_CURVE} SELECT g AS attack_type, n, {SLICE}""", "truth preds")
def _(spark, d):
    return rounded(SL.slice_report(SL.with_truth(V.preds(spark, d), V.truth(spark, d)), ["attack_type"]))


@query("sl_4_benign_vs_each", f""", kinds AS (SELECT DISTINCT attack_type AS k FROM scored WHERE attack_type <> 'benign'),
grouped AS (SELECT 'ALL(test)' AS g, y_true, y_score FROM scored
  UNION ALL SELECT 'benign vs ' || k, y_true, y_score FROM scored JOIN kinds ON attack_type IN ('benign', k)),
{GROUP_CURVE} SELECT g AS slice, n, {SLICE}""", "scored")
def _(spark, d):
    return rounded(SL.benign_versus_each(V.scored(spark, d)))


@query("sl_5_aligned_by_key", """SELECT row_id, t.y_true, t.attack_type, round(p.y_score, 6) AS y_score FROM truth t JOIN preds p USING (row_id)""",
       "truth preds")
def _(spark, d):
    return rounded(V.truth(spark, d).join(V.preds(spark, d).select("row_id", "y_score"), "row_id"))


@query("sl_6_positive_slices", f""", grouped AS (SELECT *, attack_type AS g FROM scored), {GROUP_CURVE}
SELECT g AS attack_type, CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg, round({AP}, 6) AS pr_auc
FROM group_curve GROUP BY g HAVING max(n_pos) > 0""", "scored")
def _(spark, d):
    return rounded(SL.positive_slices(V.scored(spark, d), ["attack_type"]))


# --- scores scaled, profiles --------------------------------------------------------------------------

@query("ml_8_min_max_scores", """, s AS (SELECT row_id, y_score * 3.0e0 - 1.0e0 AS x FROM scored), e AS (SELECT min(x) AS lo, max(x) AS hi FROM s)
SELECT row_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN x ELSE (x - lo) / (hi - lo + 1e-12) END, 6) AS y_score FROM s, e""", "scored")
def _(spark, d):
    moved = V.scored(spark, d).select("row_id", (F.col("y_score") * 3.0 - 1.0).alias("y_score"))
    return rounded(cleaning.min_max_scores(moved))


@query("ml_9_sigmoid", """SELECT row_id, round(1.0e0 / (1.0e0 + exp(-((y_score - 0.5e0) * 8.0e0))), 6) AS y_score FROM scored""", "scored")
def _(spark, d):
    return rounded(V.scored(spark, d).select("row_id", sigmoid((F.col("y_score") - 0.5) * 8.0).alias("y_score")))


@query("mg_10_per_profile", f""", grouped AS (SELECT *, profile AS g FROM scored), {GROUP_CURVE},
c AS (SELECT g AS profile, {AP} AS pr_auc, {AUC} AS roc_auc, arg_max(fpr, threshold) FILTER (WHERE tpr >= 0.95e0) AS fpr95
  FROM group_curve GROUP BY g),
a AS (SELECT profile, count(*) AS n, avg(y_true) AS pos_rate, avg(CASE WHEN y_true = y_pred THEN 1.0e0 ELSE 0 END) AS accuracy
  FROM scored GROUP BY profile)
SELECT profile, CAST(n AS BIGINT) AS n, round(pos_rate, 6) AS pos_rate, round(accuracy, 6) AS accuracy, round(pr_auc, 6) AS pr_auc,
  round(roc_auc, 6) AS roc_auc, round(fpr95, 6) AS fpr95 FROM c JOIN a USING (profile)""", "scored")
def _(spark, d):
    rows = V.scored(spark, d)
    found = M.summary(M.score_curve(rows, ["profile"]), ["profile"]).select(
        "profile", "pr_auc", "roc_auc", F.col("fpr_at_tpr95").alias("fpr95"))
    return rounded(found.join(M.base_rate(rows, ["profile"]), "profile").join(M.accuracy(rows, ["profile"]), "profile"))


# --- bootstrap ----------------------------------------------------------------------------------------

def weights_sql(name: str, cells: str, key: str, reps: int) -> str:
    """Poisson weights ``w`` of ``cells`` (count ``c``) for each ``rep``; ``key`` is the text a cell is hashed by."""
    def cubic(point: str) -> str:
        return f"((((((a[4] * ({point}) + a[3]) % 2147483647) * ({point}) + a[2]) % 2147483647) * ({point}) + a[1]) % 2147483647 + 0.5e0) / 2147483647"
    return f"""{name}_c AS (SELECT *, list_transform([0, 1, 2, 3],
  lambda i: ('0x' || substr(md5({key}), 1 + 8 * i, 8))::BIGINT % 2147483647) AS a FROM {cells}),
{name}_u AS (SELECT * EXCLUDE (a), {cubic('2 * rep')} AS u1 FROM {name}_c, range(1, {reps + 1}) t(rep)),
{name}_m AS (SELECT DISTINCT c FROM {name}_c),
{name}_k AS (SELECT c, unnest(range(greatest(0, c - 12 * ceil(sqrt(c))::BIGINT - 12), c + 12 * ceil(sqrt(c))::BIGINT + 13)) AS k FROM {name}_m),
{name}_p AS (SELECT c, k, exp(k * ln(c) - c - lgamma(k + 1)) AS p FROM {name}_k),
{name}_s AS (SELECT c, k, sum(p) OVER (PARTITION BY c ORDER BY k) / sum(p) OVER (PARTITION BY c) AS s FROM {name}_p),
{name}_l AS (SELECT c, min(k) AS k0, list(s ORDER BY k) AS steps FROM {name}_s GROUP BY c),
{name} AS (SELECT {name}_u.* EXCLUDE (u1), (k0 + len(list_filter(steps, lambda x: x < u1)))::DOUBLE AS w
  FROM {name}_u JOIN {name}_l USING (c))"""


CI_SQL = """SELECT {lead}metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low,
  round(quantile_cont(v, 0.975), 6) AS high FROM ({long}) GROUP BY {lead}metric"""


#: A score in whole and 2^-40 parts of 1e-9 units.
SCORE_TEXT = ("CAST(floor(y_score * 1e9) AS BIGINT)::VARCHAR || '.' || "
              "CAST(floor((y_score * 1e9 - floor(y_score * 1e9)) * 1099511627776.0e0) AS BIGINT)::VARCHAR")


def score_ci_sql(view: str, hit: str, reps: int, group: str = "") -> str:
    lead, by = (f"{group}, ", f"{group}, ") if group else ("", "")
    gkey = f"{group} || ':' || " if group else ""
    long = " UNION ALL ".join(f"SELECT {lead}'{m}' AS metric, {m} AS v FROM per_rep" for m in ("pr_auc", "fpr95", "accuracy"))
    return f""", cells AS (SELECT {lead}y_score, y_true AS t, ({hit})::INT AS hit, CAST(count(*) AS BIGINT) AS c FROM {view} GROUP BY ALL),
{weights_sql('drawn', 'cells', f"'7:' || {gkey}{SCORE_TEXT} || ':' || t || ':' || hit", reps)},
s AS (SELECT {lead}rep, y_score, sum(CASE WHEN t = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN t = 1 THEN 0 ELSE w END) AS neg,
  sum(w * hit) AS hits FROM drawn GROUP BY {by}rep, y_score),
cur AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS n_pos, sum(neg) OVER p AS n_neg FROM s
  WINDOW w AS (PARTITION BY {by}rep ORDER BY y_score DESC), p AS (PARTITION BY {by}rep)),
per_rep AS (SELECT {lead}rep, coalesce(sum(pos * tp / nullif(tp + fp, 0)) / nullif(max(n_pos), 0), 0) AS pr_auc,
  min(fp) FILTER (WHERE pos + neg > 0 AND tp > 0 AND tp / n_pos >= 0.95e0) / nullif(max(n_neg), 0) AS fpr95,
  sum(hits) / (max(n_pos) + max(n_neg)) AS accuracy FROM cur GROUP BY {by}rep)
{CI_SQL.format(lead=lead, long=long)}"""


SCORE_METRICS = ["pr_auc", "fpr95", "accuracy"]


@query("ci_1_score_bootstrap", score_ci_sql("scored", "y_true = y_pred", 1000), "scored")
def _(spark, d):
    return rounded(B.intervals(B.score_bootstrap(V.scored(spark, d), reps=1000), SCORE_METRICS))


@query("ci_1_score_bootstrap_fine", score_ci_sql("scored_fine", "y_true = y_pred", 1000), "scored_fine")
def _(spark, d):
    return rounded(B.intervals(B.score_bootstrap(V.scored_fine(spark, d), reps=1000), SCORE_METRICS))


@query("ci_2_score_bootstrap_strict", score_ci_sql("scored", "y_true = (y_score >= 0.5e0)::INT", 2000), "scored")
def _(spark, d):
    per_rep = B.score_bootstrap(V.scored(spark, d), reps=2000, decide_at=0.5)
    return rounded(B.intervals(per_rep, SCORE_METRICS, undefined="propagate"))


DECISION_METRICS = ["precision", "recall", "f1", "tpr", "fpr"]
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM per_rep" for m in DECISION_METRICS)


@query("ci_3_decision_bootstrap", f""", cells AS (SELECT y_true AS t, y_pred AS p, CAST(count(*) AS BIGINT) AS c FROM scored GROUP BY ALL),
{weights_sql('drawn', 'cells', "'7:' || t || ':' || p", 2000)},
k AS (SELECT rep, sum(w) FILTER (WHERE t = 0 AND p = 0) AS tn, sum(w) FILTER (WHERE t = 0 AND p = 1) AS fp,
  sum(w) FILTER (WHERE t = 1 AND p = 0) AS fn, sum(w) FILTER (WHERE t = 1 AND p = 1) AS tp FROM drawn GROUP BY rep),
per_rep AS (SELECT rep, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2.0e0 * tp / nullif(2.0e0 * tp + fp + fn, 0), 0) AS f1, tp / (tp + fn + 1e-12) AS tpr, fp / (fp + tn + 1e-12) AS fpr FROM k)
{CI_SQL.format(lead='', long=_LONG)}""", "scored")
def _(spark, d):
    return rounded(B.intervals(B.decision_bootstrap(V.scored(spark, d), reps=2000), DECISION_METRICS))


@query("ci_4_per_profile", score_ci_sql("scored", "y_true = y_pred", 1000, "profile"), "scored")
def _(spark, d):
    per_rep = B.score_bootstrap(V.scored(spark, d), ["profile"], reps=1000)
    return rounded(B.intervals(per_rep, SCORE_METRICS, ["profile"]))
