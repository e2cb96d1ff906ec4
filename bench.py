"""Time the headline queries: prints one JSON line.

The flagship query runs once beforehand, untimed, so that starting the JVM is not counted as a query.
Every headline query is then built, planned and run once.
"""

from __future__ import annotations

import json
import os
import time

from flowlens.plans.catalog import QUERIES, flagship
from flowlens.session import build_session

HEADLINE = [
    "mt_7_average_precision_fine", "mt_7_average_precision", "mt_10_fpr_at_tpr", "mt_14_threshold_sweep",
    "th_5_best_f1_grid", "th_7_curve_budget_on_test", "th_9_few_shot_summary", "th_12_single_shot",
    "ci_1_score_bootstrap", "ci_1_score_bootstrap_fine", "ci_3_decision_bootstrap",
    "sl_4_benign_vs_each", "sp_3_split_60_20_20", "sh_6_shift_report", "ft_3_medians",
    "fl_1_directional_flows", "fl_2_windowed_flows", "fl_3_conversations", "cl_clean_flows", "io_2_csv_to_days",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", "bench", cpus, **{
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    flagship(spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
