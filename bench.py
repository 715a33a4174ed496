"""Times the headline queries; prints one JSON line.

Each query runs twice and the faster run counts, so class loading and code
generation of the first run are left out. Results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from loanforge.plans.catalog import all_queries
from loanforge.session import local_session

HEADLINE = [
    "c1_missingness", "c3_summary_statistics", "c6_correlation_matrix", "c8_iqr_outliers",
    "d4_left_join_suffix", "d5_join_report", "d6_star_integration", "d7_as_of_month",
    "e2_stratified_split", "f1_missing_treatment", "f10_quick_iv", "g4_information_value", "g10_univariate_gini",
    "h3_ead_schedule", "h7_ecl_per_loan", "h8_ecl_by_stage",
    "j4_threshold_sweep", "j6_auc_gini", "j9_ks_statistic", "j12_gain_chart", "j19_temporal_bundle", "j20_metric_table",
    "k3_top_drivers", "l3_all_scenarios", "l4_psi", "m1_group_performance", "n4_evaluation_rules",
    "o1_section_chunks", "o3_relevant_chunks", "o4_keyword_rules", "o7_nearest_vectors", "p1_window_monitoring",
]

#: Slower queries that learn or search; timed once and kept out of the total, which stays comparable from run to run.
SLOW = [
    "d3_relationships", "f6_knn_imputation", "f7_chained_imputation", "f15_yeo_johnson", "f20_routed_preparation", "g17_feature_plan", "i4_regression_fit", "i13_ablation",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "loanforge-bench")
    queries = all_queries()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    queries["j6_auc_gini"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    slow: dict[str, float] = {}
    for name in SLOW if names is HEADLINE else []:
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        slow[name] = round(time.perf_counter() - t, 3)
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times | slow, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
