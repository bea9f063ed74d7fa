"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bindings import load  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "k1_grace_band_rates", "k7_registry_patterns", "c6_iqr_bounds", "c12_cap", "c16_fill_mean_median_constant",
    "c18_forward_fill", "c25_encode_label", "d1_numeric_profile", "d6_pearson_matrix", "d7_spearman_matrix",
    "e1_threshold_metrics", "e2_auroc", "e7_youden", "e9_decision_curve", "e11_jackknife", "e12_delong",
    "e20_subgroup_performance", "t1_random_split", "t5_stratified_folds", "i4_over_sample",
]
# Costly ones, timed once and reported beside the total, which stays comparable between rounds
HEAVY = [
    "c11_local_outlier_factor", "c19_knn_impute", "d6_pearson_matrix_wide", "d8_kendall_orders", "e10_bootstrap", "i6_smote", "i10_svm_smote",
]


def timed(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    spark = build_session(cores, "bench")
    queries["k1_grace_band_rates"](spark, sf_dir).collect()  # starts the session's code paths
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            seconds[name] = timed(spark, queries[name], sf_dir)
    heavy = {name: timed(spark, queries[name], sf_dir) for name in HEAVY}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "heavy_queries": heavy,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
