"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortwise.plans import catalog  # noqa: E402
from cohortwise.session import build_session  # noqa: E402

HEADLINE = [
    "m1_set_score_ranking", "a5_count_file_scan", "c8_master_table", "d3_median_mad", "d10_vector_mean", "e1_zscore_population", "e3_average_rank",
    "e4_percentile_rank", "e7_bh_adjust", "f1_best_row_per_entity", "f7_top_items_per_bag", "f9_control_sample", "g9_covered_cells", "h1_knn_impute",
    "h5_weighted_set_score", "h9_signed_set_score", "i4_roc_auc", "i7_welch_associations", "i9_mann_whitney_less", "i17_consensus_dispersion",
    "i22_meta_analysis", "j1_repeated_kfold", "j4_crossfit_predictions", "j6_logistic_terms", "j10_cox_models", "j15_standardized_residuals",
    "j18_nmf_scores", "k1_label_shuffle_null", "k2_retraining_null",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus))
    # One small query first, so that the first measured one does not pay for the JVM.
    catalog.QUERIES["d7_named_aggregates"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
