"""Seconds per headline query.

    BENCH_SF_DIR (default /root/testdata/sf0.1)   folder of the test tables
    BENCH_CPUS   (default: all)                   cores of the local master
    BENCH_QUERIES                                 comma-separated names instead of the headline list

Each query is built and run to its last row without keeping the rows; one small query runs first so that
start-up is not counted. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from signalframe.plans.catalog import QUERIES  # noqa: E402
from signalframe.session import build_session  # noqa: E402

HEADLINE = [
    "latest_per_series", "gold_features", "gold_features_chunked", "h7_features", "gold_incremental", "impute_ffill",
    "predictions", "predictions_wide", "baseline_probs", "metrics_overall", "metrics_by_threshold", "reliability_bins",
    "policy_eval", "policy_sweep", "policy_by_regime", "balanced_topk", "rolling_policy_metrics", "walkforward_folds",
    "silver_dedup", "landing_audit", "latest_artifacts", "signal_history", "run_manifest", "digest_rows",
    "subscription_state", "quota_windows", "stream_quota", "walkforward_logreg", "walkforward_calibrated",
    "fit_per_series", "fit_global", "walkforward_daily", "walkforward_gbt", "stream_silver", "silver_upsert",
    "walkforward_pooled", "fit_offsets", "gold_versions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rows_by_series"](spark, folder).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
