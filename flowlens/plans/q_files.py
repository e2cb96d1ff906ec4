"""Queries: sources and sinks, log reports, streams and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import features as FT
from flowlens.operators import labels as LB
from flowlens.operators import leafwise as LW
from flowlens.operators import merge as MG
from flowlens.operators import metrics as M
from flowlens.operators import models as ML
from flowlens.operators import reports as RP
from flowlens.operators import splits as SP
from flowlens.operators import thresholds as TH
from flowlens.plans import views as V
from flowlens.plans.q_tables import ENDPOINTS, count_of
from flowlens.plans.q_scores import split_sql
from flowlens.plans.registry import query, rounded
from flowlens.plans.staging import named_csv, named_texts
from flowlens.schemas import FEATURE_SETS, PACKET_SCHEMA
from flowlens.session import saved, scratch_path
from flowlens.sources import files as S
from flowlens.sources import sinks as K
from flowlens.streaming import flows as ST

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]


# --- sources and sinks --------------------------------------------------------------------------------

@query("io_1_scan_csv", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, d):
    path = scratch_path(spark, "csv")
    K.write_csv(V.table(spark, d, "events").select(*EVENT_COLUMNS), path)
    return S.scan_csv(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


def _day_files(spark, d):
    """Two CSV files per weekday and one of an unknown day, with padded names and infinite values."""
    rows = V.day_flows(spark, d).select(
        F.when(F.col("hour") == 0, "holiday").otherwise(F.concat(F.lit("Capture-"), F.col("day"), F.lit("-"), F.col("user_id") % 2)).alias("name"),
        F.col("event_id").alias(" Event"), F.when(F.col("value") > 200, "Infinity").otherwise(F.col("value").cast("string")).alias(" Flow Bytes"),
        F.col("user_id").alias("Source IP"), F.col("Label").alias(" Label"))
    return named_csv(rows, "name")


DAY_ROWS = """, r AS (SELECT CASE WHEN hour = 0 THEN 'Unknown' WHEN day IN ('Saturday', 'Sunday') THEN 'Unknown' ELSE day END AS day,
  CAST(event_id AS DOUBLE) AS event, CASE WHEN value > 200 THEN NULL ELSE value END AS bytes, trim("Label") AS label FROM day_flows)"""


@query("io_2_csv_to_days", DAY_ROWS + " SELECT day, event, bytes, label FROM r", "day_flows")
def _(spark, d):
    target = scratch_path(spark, "days")
    S.csv_to_days(spark, _day_files(spark, d), target)
    return spark.read.parquet(target).select("day", F.col("Event").alias("event"), F.col("`Flow Bytes`").alias("bytes"), F.col("Label").alias("label"))


@query("io_9_scan_days", DAY_ROWS + " SELECT day, label, CAST(count(*) AS BIGINT) AS n FROM r WHERE day IN ('Tuesday', 'Friday') GROUP BY 1, 2", "day_flows")
def _(spark, d):
    target = scratch_path(spark, "days")
    S.csv_to_days(spark, _day_files(spark, d), target)
    return count_of(S.scan_days(spark, target, ["Tuesday", "Friday"]).withColumnRenamed("Label", "label"), "day", "label")


@query("io_3_union_csv", """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS user_id FROM events""")
def _(spark, d):
    e = V.table(spark, d, "events")
    even = e.where("user_id % 2 = 0").select(F.lit("a").alias("name"), "event_type", "user_id", "event_id")
    odd = e.where("user_id % 2 = 1").select(F.lit("b").alias("name"), "event_id", "event_type")
    root = scratch_path(spark, "union")
    for side, part in (("even", even), ("odd", odd)):
        K.write_csv(part.drop("name"), f"{root}/{side}")
    return S.union_csv(spark, root).drop("file_name")


def _phase_files(spark, d):
    """A file per kind of attack and repetition, and files whose names do not match."""
    rows = V.scored(spark, d).select(
        F.concat_ws("_", F.when(F.col("profile") == "profile_2", "note").otherwise(F.col("attack_type")), F.month("seen")).alias("name"),
        F.round(F.col("y_score") * 1000).cast("int").alias(" dur "), "row_id")
    return named_csv(rows, "name")


PHASES = """, r AS (SELECT attack_type, CAST(month(seen) AS INTEGER) AS rep, CAST(CAST(round(y_score * 1000) AS INTEGER) AS VARCHAR) AS dur, row_id
  FROM scored WHERE profile <> 'profile_2')"""


@query("io_4_phase_from_name", PHASES + " SELECT * FROM r", "scored")
def _(spark, d):
    return S.with_phase(S.union_csv(spark, _phase_files(spark, d))).drop("file_name")


@query("mg_2_phase_folder", PHASES + """ SELECT attack_type, rep, CASE WHEN attack_type = 'benign' THEN 0 ELSE 1 END AS y_true, CAST(count(*) AS BIGINT) AS n,
  round(avg(CAST(dur AS DOUBLE)), 6) AS mean_dur FROM r GROUP BY 1, 2""", "scored")
def _(spark, d):
    merged = MG.merge_phases(S.with_phase(S.union_csv(spark, _phase_files(spark, d))))
    return rounded(merged.groupBy("attack_type", "rep", "y_true").agg(F.count(F.lit(1)).alias("n"), F.avg("dur").alias("mean_dur")))


@query("io_5_day_from_name", """SELECT CASE WHEN hour = 0 THEN 'Unknown' WHEN day IN ('Saturday', 'Sunday') THEN 'Unknown' ELSE day END AS day, CAST(count(*) AS BIGINT) AS n
FROM day_flows GROUP BY 1""", "day_flows")
def _(spark, d):
    return count_of(S.with_day(S.union_csv(spark, _day_files(spark, d))), "day")


def _supplier_files(spark, d):
    """A file per supplier, of which those in debt have nothing below their header."""
    s = V.table(spark, d, "supplier")
    body = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("\n"), F.col("s_suppkey"), F.lit(",1"))).otherwise("")
    kind = F.when(F.col("s_nationkey") < 9, "benign").when(F.col("s_nationkey") < 20, "attack_scan").otherwise("other")
    rows = s.select(F.concat_ws("_", kind, "s_suppkey").alias("name"), F.concat(F.lit("dur,spkts"), body).alias("value"))
    return named_texts(rows, "name", "value", ".csv")


SUPPLIERS = """WITH s AS (SELECT CASE WHEN s_nationkey < 9 THEN 'benign' WHEN s_nationkey < 20 THEN 'attack_scan' ELSE 'other' END AS kind, * FROM supplier)"""


@query("io_6_empty_files", SUPPLIERS + " SELECT kind || '_' || s_suppkey || '.csv' AS file_name FROM s WHERE s_acctbal < 0")
def _(spark, d):
    return S.empty_files(spark, _supplier_files(spark, d))


@query("io_17_phase_inventory", SUPPLIERS + """ SELECT p.phase, CAST((SELECT count(*) FROM s WHERE kind = p.phase) AS BIGINT) AS files
FROM (SELECT unnest(['benign', 'attack_scan', 'attack_c2_beacon', 'attack_lateral', 'attack_exfil_burst', 'attack_exfil_lowslow']) AS phase) p""")
def _(spark, d):
    found = S.phase_inventory(S.list_files(spark, _supplier_files(spark, d)))
    return found.groupBy("phase").agg(F.sum("files").alias("files"))


@query("io_7_scan_packets", "SELECT ip_proto, v6_nxt, ip_src, ip_dst, v6_src, v6_dst, tcp_sp, tcp_dp, udp_sp, udp_dp, flen, round(t, 3) AS t FROM packets", "packets")
def _(spark, d):
    path = scratch_path(spark, "tsv")
    V.packets(spark, d).select(*PACKET_SCHEMA.names).write.option("sep", "\t").csv(path)
    return S.scan_packets(spark, path).withColumn("t", F.round("t", 3))


@query("io_8_projected_scan", """SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _(spark, d):
    return count_of(V.table(spark, d, "events").select("event_type"), "event_type")


@query("io_10_prediction_table", "SELECT row_id, attack_type, y_true, round(y_score, 6) AS y_score, y_pred FROM scored", "scored")
def _(spark, d):
    path = scratch_path(spark, "preds")
    K.write_predictions(V.scored(spark, d), path)
    return rounded(spark.read.parquet(path))


@query("io_11_csv_sink", "SELECT profile, CAST(count(*) AS BIGINT) AS n, round(avg(y_true), 6) AS pos_rate FROM scored GROUP BY 1", "scored")
def _(spark, d):
    path = scratch_path(spark, "csv")
    K.write_csv(M.base_rate(V.scored(spark, d), ["profile"]), path)
    return rounded(S.scan_csv(spark, path, "profile string, n bigint, pos_rate double"))


@query("io_12_json_sink", """SELECT profile, round(avg(y_score), 6) AS mean, round(min(y_score), 6) AS low, round(max(y_score), 6) AS high FROM scored GROUP BY 1""", "scored")
def _(spark, d):
    path = scratch_path(spark, "json")
    nested = V.scored(spark, d).groupBy("profile").agg(F.struct(
        F.avg("y_score").alias("mean"), F.min("y_score").alias("low"), F.max("y_score").alias("high")).alias("ci"))
    K.write_json(nested, path)
    return rounded(spark.read.schema(nested.schema).json(path).select("profile", "ci.*"))


@query("io_13_newest_per_pattern", """, files AS (SELECT 'runs/' || o_custkey || '/' || lower(o_orderpriority) || '_' || o_orderkey || '.txt' AS path, o_orderdate AS modified FROM orders),
p AS (SELECT * FROM (VALUES ('urgent', '/1-urgent_[0-9]+\\.txt$'), ('low', '/5-low_[0-9]+\\.txt$'), ('none', '/absent_')) v(name, pattern))
SELECT name, path FROM files JOIN p ON regexp_matches(path, pattern) QUALIFY row_number() OVER (PARTITION BY name ORDER BY modified DESC, path) = 1""".replace(", files AS", "WITH files AS", 1))
def _(spark, d):
    listing = V.table(spark, d, "orders").select(
        F.concat(F.lit("runs/"), "o_custkey", F.lit("/"), F.lower("o_orderpriority"), F.lit("_"), "o_orderkey", F.lit(".txt")).alias("path"),
        F.col("o_orderdate").alias("modified"))
    patterns = {"urgent": r"/1-urgent_[0-9]+\.txt$", "low": r"/5-low_[0-9]+\.txt$", "none": "/absent_"}
    return RP.newest_per_pattern(listing, patterns).select("name", "path")


# --- reports from logs --------------------------------------------------------------------------------

def _logs(spark, d, *lines):
    """A log file per supplier from text expressions; lines that are null are not printed."""
    s = V.table(spark, d, "supplier").withColumns({"k": F.col("s_suppkey"), "c": F.round(F.abs("s_acctbal") * 100).cast("bigint")})
    rows = s.select(F.concat(F.lit("run_"), "k").alias("name"), F.concat_ws("\n", *lines).alias("value"))
    logs = S.scan_logs(spark, named_texts(rows, "name", "value"))
    return logs.withColumn("experiment", F.regexp_extract("path", r"([^/]+)\.txt$", 1))


def _six(units):
    """Six decimals of a whole number of millionths, the sign before them."""
    size = F.abs(units)
    return F.format_string("%s%d.%06d", F.when(units < 0, "-").otherwise(""), F.floor(size / 1000000).cast("bigint"),
                           (size % 1000000).cast("bigint"))


def _interval(label, base):
    """An interval in millionths, as logs print it."""
    return F.concat(F.lit(f"  {label} mean="), _six(base), F.lit("  CI95=["), _six(base - 100), F.lit(", "), _six(base + 100), F.lit("]"))


@query("rp_1_log_intervals", """WITH s AS (SELECT 'run_' || s_suppkey AS experiment, s_suppkey AS k, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier),
m AS (SELECT experiment, 'prauc' AS metric, c AS b FROM s UNION ALL SELECT experiment, 'fpr95', c + 1000 FROM s UNION ALL SELECT experiment, 'acc', c + 2000 FROM s WHERE k % 3 <> 0)
SELECT experiment, metric, round(b / 1e6, 6) AS mean, round((b - 100) / 1e6, 6) AS low, round((b + 100) / 1e6, 6) AS high FROM m""")
def _(spark, d):
    logs = _logs(spark, d, F.lit("[RESULT] Bootstrap (B=2000)"), _interval("PR-AUC", F.col("c")),
                 _interval("FPR@TPR=0.95", F.col("c") + 1000),
                 F.when(F.col("k") % 3 != 0, _interval("ACC", F.col("c") + 2000)))
    return rounded(RP.log_intervals(logs, RP.SCORE_LABELS).select("experiment", "metric", "ci.*"))


@query("rp_1_log_decision_intervals", """WITH s AS (SELECT 'run_' || s_suppkey AS experiment, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier),
m AS (SELECT experiment, metric, c + i * 1000 AS b FROM s, (VALUES ('precision', 0), ('recall', 1), ('f1', 2), ('tpr', 3), ('fpr', 4)) v(metric, i))
SELECT experiment, metric, round(b / 1e6, 6) AS mean, round((b - 100) / 1e6, 6) AS low, round((b + 100) / 1e6, 6) AS high FROM m""")
def _(spark, d):
    names = ["Precision", "Recall   ", "F1       ", "TPR      ", "FPR      "]
    logs = _logs(spark, d, *[_interval(n, F.col("c") + 1000 * i) for i, n in enumerate(names)])
    return rounded(RP.log_intervals(logs, RP.DECISION_LABELS).select("experiment", "metric", "ci.*"))


@query("rp_2_log_few_shot", """SELECT 'run_' || s_suppkey AS experiment, 200 AS k, 50 AS reps, round(c / 1e6, 6) AS f1_mean, 0.01e0 AS f1_std, round((c + 1) / 1e6, 6) AS p_mean,
  0.02e0 AS p_std, round((c + 2) / 1e6, 6) AS r_mean, 0.003e0 AS r_std FROM (SELECT *, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier) WHERE s_suppkey % 4 <> 1""")
def _(spark, d):
    def line(label, units, std):
        return F.concat(F.lit(f" {label} mean= "), _six(units), F.lit(f" std= {std}"))
    logs = _logs(spark, d, F.lit("[FewShot] k= 200 reps= 50"), line("F1", F.col("c"), "0.01"), line("P ", F.col("c") + 1, "2e-2"),
                 F.when(F.col("k") % 4 != 1, line("R ", F.col("c") + 2, "0.003")))
    return rounded(RP.log_few_shot(logs))


@query("rp_2_log_points", """WITH s AS (SELECT 'run_' || s_suppkey AS experiment, s_suppkey AS k, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier)
SELECT experiment, 'point' AS kind, round(c / 1e6, 6) AS a, round((c + 5) / 1e6, 6) AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS d FROM s WHERE k % 2 = 0
UNION ALL SELECT experiment, 'oracle', round((c + 1) / 1e6, 6), round((c + 2) / 1e6, 6), round((c + 3) / 1e6, 6), round((c + 4) / 1e6, 6) FROM s
UNION ALL SELECT experiment, 'best_f1', round((c + 2) / 1e6, 6), round((c + 1) / 1e6, 6), round((c + 3) / 1e6, 6), round((c + 4) / 1e6, 6) FROM s""")
def _(spark, d):
    c = F.col("c")
    logs = _logs(spark, d, F.when(F.col("k") % 2 == 0, F.concat(F.lit("PR-AUC(AP): "), _six(c), F.lit("\nlines between\nFPR@TPR=0.95: "), _six(c + 5))),
                 F.concat(F.lit("[ORACLE] best_F1= "), _six(c + 1), F.lit(" thr= "), _six(c + 2)),
                 F.concat(F.lit(" precision= "), _six(c + 3), F.lit("  recall= "), _six(c + 4)),
                 F.concat(F.lit("[BestF1]\n thr= "), _six(c + 2), F.lit(" F1= "), _six(c + 1), F.lit(" P= "), _six(c + 3), F.lit(" R= "), _six(c + 4)))
    point = RP.log_points(logs, RP.POINT, ["a", "b"]).withColumn("kind", F.lit("point"))
    parts = [RP.log_points(logs, p, ["a", "b", "c", "d"]).withColumn("kind", F.lit(n)) for n, p in (("oracle", RP.ORACLE), ("best_f1", RP.BEST_F1))]
    return rounded(MG.union_by_name([point, *parts]).select("experiment", "kind", "a", "b", "c", "d"))


@query("rp_3_summary_table", """WITH s AS (SELECT 'run_' || s_suppkey AS experiment, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier),
e AS (SELECT unnest(['run_1', 'run_2', 'run_3', 'absent']) AS experiment)
SELECT experiment, round(c / 1e6, 6) AS prauc, round((c + 900) / 1e6, 6) AS fpr95_low, CASE WHEN c IS NULL THEN 'NA' ELSE printf('%.6f [%.6f, %.6f]', c / 1e6, (c - 100) / 1e6, (c + 100) / 1e6) END AS printed
FROM e LEFT JOIN s USING (experiment)""")
def _(spark, d):
    logs = _logs(spark, d, _interval("PR-AUC", F.col("c")), _interval("FPR@TPR=0.95", F.col("c") + 1000))
    found = RP.summary_table(RP.log_intervals(logs, RP.SCORE_LABELS), ["run_1", "run_2", "run_3", "absent"])
    ci = F.try_element_at("metrics", F.lit("prauc"))
    return rounded(found.select("experiment", ci["mean"].alias("prauc"), F.try_element_at("metrics", F.lit("fpr95"))["low"].alias("fpr95_low"),
                                RP.printed_interval(ci).alias("printed")))


@query("rp_4_parse_shift_table", """WITH s AS (SELECT s_suppkey AS k, CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS c FROM supplier)
SELECT 'Feature No ' || k AS feature, round(CASE WHEN k % 3 = 0 THEN k / 1e6 ELSE c / 1e6 END, 6) AS psi, round(CASE WHEN k % 3 = 0 THEN 1155.306e0 ELSE k / 1e6 END, 6) AS ks
FROM s WHERE k % 5 <> 0 ORDER BY psi DESC, feature LIMIT 10""")
def _(spark, d):
    """Every third table has a word for its PSI, every fifth ends before its row; rows before and after the table don't count."""
    row = F.concat(F.lit("   Feature No   "), "k", F.lit("  num "), F.when(F.col("k") % 3 == 0, "n/a").otherwise(_six(F.col("c"))),
                   F.lit(" "), _six(F.col("k")), F.lit(" NaN 1.155306e+03"))
    row = F.when(F.col("k") % 3 == 0, F.regexp_replace(row, " NaN", "")).otherwise(row)
    logs = _logs(spark, d, F.lit("# Shift diagnostic"), F.lit("  early  num 99 99"), F.lit("                feature type  psi  ks  tv"),
                 F.lit("# passed over num 98 98"), F.when(F.col("k") % 5 == 0, ""), row, F.lit("       proto  cat  NaN  NaN  0.5"),
                 F.lit(""), F.lit("  late  num 97 97"), F.lit("## Notes"))
    return rounded(RP.parse_shift_table(logs))


# --- streams ------------------------------------------------------------------------------------------

@query("st_1_streaming_flows", f""", {ENDPOINTS}
SELECT round(max(t) - min(t), 6) AS dur, protocol AS proto, saddr, coalesce(sport, '0') AS sport, daddr, coalesce(dport, '0') AS dport,
  CAST(count(*) AS BIGINT) AS spkts, CAST(0 AS BIGINT) AS dpkts, CAST(sum(flen) AS BIGINT) AS sbytes, CAST(0 AS BIGINT) AS dbytes,
  'OK' AS state, CAST(floor(t / 3600) * 3600 AS BIGINT) AS win_start FROM ends GROUP BY protocol, saddr, sport, daddr, dport, floor(t / 3600)""", "packets")
def _(spark, d):
    source, target = scratch_path(spark, "packets"), scratch_path(spark, "flows")
    # Time-ordered input, so that no packet is late and the result must equal the batch one.
    V.packets(spark, d).drop("ts").repartitionByRange(4, "t").write.parquet(source)
    schema = spark.read.parquet(source).schema
    flows = ST.streaming_flows(ST.packet_stream(spark, source, schema, 4), "1 hour", "40 days")
    ST.run_available(flows, target, scratch_path(spark, "state"), mode="update")
    latest = ST.latest_flows(spark.read.parquet(target))
    return rounded(latest.withColumn("win_start", F.unix_seconds("win_start")))


#: The run in which a packet arrives: six days to a run, some one or two runs late.
RUN = "least(4, CAST(floor((day(ts) - 1) / 6) AS INT) + CASE WHEN packet_id % 41 = 0 THEN 2 WHEN packet_id % 17 = 0 THEN 1 ELSE 0 END)"


@query("st_1_late_packets", f""", {ENDPOINTS}, w AS (SELECT *, CAST(trunc(t * 1000000) AS BIGINT) AS us, {RUN} AS run FROM ends),
s AS (SELECT min(us) AS start FROM w WHERE run = 0), m AS (SELECT run, max(us) AS top FROM w GROUP BY run),
k AS (SELECT r.run, max(m.top) // 1000 * 1000 - 43200000000 AS mark FROM range(1, 6) r(run) JOIN m ON m.run < r.run GROUP BY r.run),
v AS (SELECT w.*, CAST(floor((us - start) / 3600000000) AS BIGINT) AS win, start FROM w, s),
kept AS (SELECT v.* FROM v LEFT JOIN k USING (run) WHERE mark IS NULL OR start + (win + 1) * 3600000000 > mark)
SELECT round(max(t) - min(t), 6) AS dur, protocol AS proto, saddr, coalesce(sport, '0') AS sport, daddr, coalesce(dport, '0') AS dport,
  CAST(count(*) AS BIGINT) AS spkts, CAST(0 AS BIGINT) AS dpkts, CAST(sum(flen) AS BIGINT) AS sbytes, CAST(0 AS BIGINT) AS dbytes, 'OK' AS state, win
FROM kept WHERE start + (win + 1) * 3600000000 <= (SELECT mark FROM k WHERE run = 5) GROUP BY protocol, saddr, sport, daddr, dport, win""", "packets")
def _(spark, d):
    """A capture in five runs, each a restart from the checkpoint; what is late by SQL is dropped, closed windows are appended."""
    source, target, state = (scratch_path(spark, n) for n in ("packets", "flows", "state"))
    packets = V.packets(spark, d).withColumn("run", F.expr(RUN))
    for run in range(5):
        packets.where(F.col("run") == run).drop("run", "ts").coalesce(4).write.mode("append").parquet(source)
        arrived = spark.read.parquet(source)
        start = ST.capture_start(arrived, f"{state}-start")
        flows = ST.capture_flows(ST.packet_stream(spark, source, arrived.schema), start, 3600, "12 hours")
        ST.run_available(flows, target, state, mode="append")
    return rounded(spark.read.parquet(target).drop("batch_id"))


NUMERIC, TEXT = ["dur", "spkts", "sbytes"], ["proto", "state"]
#: Enough for a split between any two values of the packets and bytes below.
BINS = 128


def _split_rows(spark, d, strata="y_true"):
    """Training and test rows of the flows with gaps, the split saved once."""
    parts = saved(SP.train_test(V.gap_flows(spark, d), 0.3, [strata]))
    return parts.where("split = 'train'"), parts.where("split = 'test'")


#: The test rows in SQL. The classes lie apart, so what a classifier must decide is the label itself.
TEST_ROWS = f", {split_sql('parts', 'gap_flows', 'ceil(0.3e0 * n)', names=('test', 'train'))}, t AS (SELECT * FROM parts WHERE split = 'test')"
DECIDED = TEST_ROWS + " SELECT row_id, y_true, y_true AS y_pred FROM t"
KIND_ROWS = TEST_ROWS.replace("PARTITION BY y_true", "PARTITION BY kind")
PERFECT = "1.0e0 AS pr_auc, 0.0e0 AS fpr95, 1.0e0 AS accuracy"


def _decisions(scored):
    return scored.select("row_id", "y_true", "y_pred")


@query("st_2_streaming_alarms", TEST_ROWS + " SELECT row_id, y_true, proto, state FROM t WHERE y_true = 1", "gap_flows")
def _(spark, d):
    """Fitted on the training rows; the test rows arrive as files, of which each batch takes a few."""
    train, test = _split_rows(spark, d)
    model = ML.fit(train, ML.forest(100, maxBins=BINS), NUMERIC, TEXT)
    source, target = scratch_path(spark, "flows"), scratch_path(spark, "alarms")
    test = test.drop("split")
    K.write_csv(test.repartition(6), source)
    ST.run_available(ST.alarms(ST.flow_stream(spark, source, test.schema, 2), model, 0.5), target, scratch_path(spark, "state"))
    return spark.read.parquet(target).select("row_id", "y_true", "proto", "state")


# --- classifiers --------------------------------------------------------------------------------------

def _flow_rows(spark, d):
    """Labelled flows from order lines, the score view's signal hidden in the byte count."""
    lines = V.table(spark, d, "lineitem")
    positive = F.col("l_returnflag") == "R"
    return lines.select(
        V._line_key().alias("row_id"), positive.cast("int").alias("y_true"), F.col("l_tax").alias("dur"),
        F.col("l_linestatus").alias("proto"), F.concat(F.lit("S"), F.col("l_linenumber")).alias("state"),
        F.col("l_quantity").alias("spkts"), F.lit(0.0).alias("dpkts"),
        (F.col("l_extendedprice") + F.when(positive, 40000.0).otherwise(0.0)).alias("sbytes"), F.lit(0.0).alias("dbytes"),
        (F.col("l_partkey") % 1000).cast("double").alias("sport"),
        (F.when(positive, 443).otherwise(80) + F.col("l_suppkey") % 3).cast("double").alias("dport"))


@query("ml_1_class_weights", """, n AS (SELECT y_true, count(*) AS c, sum(count(*)) OVER () AS n FROM scored GROUP BY 1)
SELECT y_true, round(n / (2.0e0 * c), 6) AS weight, CAST(c AS BIGINT) AS n FROM n""", "scored")
def _(spark, d):
    return rounded(count_of(LB.class_weights(V.scored(spark, d), [0, 1]), "y_true", "weight"))


@query("ml_1_logistic", DECIDED, "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    return _decisions(ML.score(ML.fit(LB.class_weights(train, [0, 1]), ML.logistic(2500, "weight"), NUMERIC, TEXT), test))


@query("ml_2_forest", DECIDED, "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    return _decisions(ML.score(ML.fit(train, ML.forest(200, maxBins=BINS), NUMERIC, TEXT), test))


@query("ml_3_boosted", DECIDED, "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    return _decisions(ML.score(ML.fit(train, ML.boosted(600, 6, 0.05, maxBins=BINS), NUMERIC, TEXT), test))


@query("ml_3_leafwise", DECIDED, "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    return _decisions(LW.score(LW.fit(train, NUMERIC, rounds=10, rate=0.5), test))


@query("ml_4_perceptron", DECIDED, "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    return _decisions(ML.score(ML.fit(train, ML.perceptron(len(NUMERIC)), NUMERIC), test))


@query("ml_5_multiclass_logistic", KIND_ROWS + " SELECT row_id, kind AS y_true, kind AS y_pred FROM t", "gap_flows")
def _(spark, d):
    train, test = (x.withColumn("y_true", F.col("kind")) for x in _split_rows(spark, d, "kind"))
    return ML.classify(ML.fit(train, ML.logistic(200), ["volume", "dur"], TEXT), test)


@query("ml_5_multiclass_forest", KIND_ROWS + """, r AS (SELECT CAST(kind AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS support FROM t GROUP BY 1
  UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), CAST(count(*) AS BIGINT) FROM t)
SELECT class, CASE WHEN class <> 'accuracy' THEN 1.0e0 END AS precision, CASE WHEN class <> 'accuracy' THEN 1.0e0 END AS recall, 1.0e0 AS f1, support FROM r""", "gap_flows")
def _(spark, d):
    train, test = (x.withColumn("y_true", F.col("kind")) for x in _split_rows(spark, d, "kind"))
    return M.classification_report(ML.classify(ML.fit(train, ML.forest(200, maxBins=BINS), ["volume", "dur"], TEXT), test))


@query("ml_6_fit_and_score", TEST_ROWS + """ SELECT CAST(count(*) AS BIGINT) AS n, avg(y_true) AS pos_rate, 1.0e0 AS pr_auc, 1.0e0 AS roc_auc,
  0.0e0 AS fpr_at_tpr95, 1.0e0 AS tpr_at_fpr01 FROM t""", "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    scored = ML.predictions(ML.fit(train, ML.logistic(200), NUMERIC, TEXT), test)
    summary = M.summary(M.score_curve(scored), budgets=(0.01,))
    return rounded(summary.select("pr_auc", "roc_auc", "fpr_at_tpr95", F.col("tpr_at_fpr01"))).join(M.base_rate(scored))


@query("ml_7_score_new_table", TEST_ROWS + " SELECT row_id, y_true AS y_pred FROM t", "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    model = ML.fit(train, ML.forest(100, maxBins=BINS), ["spkts", "sbytes", "dur"], ["proto"])
    return ML.score_new(model, test.select("row_id", "sbytes", "spkts")).select("row_id", "y_pred")


@query("io_14_saved_pipeline", TEST_ROWS + " SELECT row_id, y_true AS y_pred, true AS same_score, 'dur spkts sbytes, proto state' AS features FROM t", "gap_flows")
def _(spark, d):
    train, test = _split_rows(spark, d)
    path = scratch_path(spark, "model")
    model = ML.fit(train, ML.logistic(200), NUMERIC, TEXT)
    ML.save(model, path)
    again = ML.load(path)
    now = ML.score(model, test).select(F.col("row_id").alias("of"), F.col("y_score").alias("before"))
    listed = ", ".join(" ".join(names) for names in ML.feature_list(again))
    return ML.score(again, test).join(now, F.col("row_id") == F.col("of")).select(
        "row_id", "y_pred", (F.col("y_score") == F.col("before")).alias("same_score"), F.lit(listed).alias("features"))


@query("io_14_fitted_values", f""", {split_sql('parts', 'gap_flows', 'ceil(0.3e0 * n)', names=('test', 'train'))},
f AS (SELECT *, median(dur) OVER () AS d, median(spkts) OVER () AS p, median(sbytes) OVER () AS b FROM parts WHERE split = 'train'),
u AS (SELECT 'dur' AS feature, median(dur) AS filled, stddev_pop(coalesce(dur, d)) AS scale FROM f
  UNION ALL SELECT 'spkts', median(spkts), stddev_pop(coalesce(spkts, p)) FROM f
  UNION ALL SELECT 'sbytes', median(sbytes), stddev_pop(coalesce(sbytes, b)) FROM f)
SELECT feature, CAST(round(filled, 6) AS VARCHAR) AS filled, round(scale, 6) AS scale FROM u
UNION ALL SELECT 'proto', (SELECT proto FROM f WHERE proto IS NOT NULL GROUP BY proto ORDER BY count(*) DESC, proto LIMIT 1), NULL
UNION ALL SELECT 'state', (SELECT state FROM f GROUP BY state ORDER BY count(*) DESC, state LIMIT 1), NULL""", "gap_flows")
def _(spark, d):
    """What a saved pipeline has learnt, read back from it: medians, modes and population scales of the training rows."""
    path = scratch_path(spark, "model")
    ML.save(ML.fit(_split_rows(spark, d)[0], ML.logistic(10), NUMERIC, TEXT), path)
    filled, scales = ML.fitted_values(ML.load(path))
    return rounded(spark.createDataFrame(
        [(c, str(round(v, 6)) if isinstance(v, float) else v, scales.get(c)) for c, v in filled.items()],
        "feature string, filled string, scale double"))


@query("ml_10_model_comparison", f" SELECT unnest(['forest', 'logreg']) AS model, {PERFECT}")
def _(spark, d):
    train, test = _split_rows(spark, d)
    return rounded(ML.model_report(ML.compare(train, test, {"logreg": ML.logistic(200), "forest": ML.forest(200, maxBins=BINS)}, NUMERIC, TEXT)))


@query("ml_11_feature_sets", f" SELECT unnest(['portable', 'ports']) AS feature_set, {PERFECT}")
def _(spark, d):
    train, test = _split_rows(spark, d)
    parts = []
    for name, columns in FEATURE_SETS.items():
        numeric = [c for c in columns if c not in TEXT]
        model = ML.fit(train, ML.forest(200, maxBins=BINS), numeric, TEXT)
        parts.append(ML.predictions(model, test).withColumn("feature_set", F.lit(name)))
    return rounded(ML.model_report(MG.union_by_name(parts), ["feature_set"]))


@query("ml_12_best_by_validation", " SELECT unnest(range(1, 21))::INTEGER AS round, 1.0e0 AS pr_auc, unnest(range(1, 21)) = 1 AS chosen")
def _(spark, d):
    train, val = _split_rows(spark, d)
    model = ML.fit(train, ML.boosted(20, 6, 0.3, subsample=1.0, maxBins=BINS), NUMERIC, TEXT)
    best, _, table = ML.best_rounds(model, val)
    return rounded(table).withColumn("chosen", F.col("round") == best)


@query("ft_6_one_hot", """SELECT state, CASE WHEN state <= 'S5' THEN CAST(substr(state, 2, 1) AS INTEGER) - 1 END AS slot, CAST(n AS BIGINT) AS n FROM (
  SELECT 'S' || l_linenumber AS state, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    rows = _flow_rows(spark, d).select("state", "dur")
    fitted = Pipeline(stages=ML.preparation(["dur"], ["state"])).fit(rows.where("state <= 'S5'"))
    hot = vector_to_array("__f_state__hot")
    slot = F.array_position(hot, 1.0)
    return count_of(fitted.transform(rows).select("state", F.when(slot > 0, slot - 1).cast("int").alias("slot")), "state", "slot")


@query("ft_12_dense_matrix", """, m AS (SELECT *, median(dur) OVER () AS d, median(spkts) OVER () AS p, median(sbytes) OVER () AS b FROM gap_flows)
SELECT row_id, CAST(CAST(coalesce(dur, d) AS FLOAT) AS DOUBLE) AS dur, CAST(CAST(coalesce(spkts, p) AS FLOAT) AS DOUBLE) AS spkts,
  CAST(CAST(coalesce(sbytes, b) AS FLOAT) AS DOUBLE) AS sbytes FROM m""", "gap_flows")
def _(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    flows = V.gap_flows(spark, d)
    rows = FT.impute_medians(flows, FT.fit_medians(flows, NUMERIC), NUMERIC)
    dense = VectorAssembler(inputCols=NUMERIC, outputCol="features", handleInvalid="error").transform(rows)
    dense = dense.select("row_id", vector_to_array("features", "float32").alias("f"))
    return dense.select("row_id", *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(NUMERIC)])
