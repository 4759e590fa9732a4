"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from scorewright.plans.catalog import load
from scorewright.session import get_session

HEADLINE = [
    "column_profile", "missing_report", "iqr_outliers", "data_quality_score", "sensitive_value_hits", "text_features", "datetime_features",
    "out_of_time_split", "woe_bins", "iv_table", "weighted_iv", "woe_transform", "chi_merge_bins", "tree_bins", "threshold_rule_metrics", "compound_rule_metrics",
    "rule_directions", "tree_rules", "combination_tree_rules", "rule_overlap", "prior_rule_increment", "rule_amounts", "best_rules_overlap", "best_rules_greedy",
    "rule_psi", "rule_stability_cv", "correlation_pairs", "vif", "logit_statistics", "stepwise_selection", "apply_scorecard", "ks_auc_gini", "score_bands", "feature_csi",
    "channel_health_batch", "group_rates", "mined_rule_set", "built_scorecard",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = sys.argv[1:] or HEADLINE
    # one untimed query starts the JVM's code paths and the Python workers
    queries["group_rates"](spark, sf).collect()
    queries["vif"](spark, sf).collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
