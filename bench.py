"""Headline queries over whole tables; prints one JSON line with seconds per query."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from firmground.plans import load
from firmground.session import local_session

HEADLINE = [
    "au01_grain_check", "au04_null_corr", "au13_linkage", "au17_auc_signal", "au18_mutual_information", "au20_outlier_fence",
    "au24_near_constant", "au33_corr_matrix", "au36_pii_scan", "lk01_leak_scan", "lk04_split_overlap", "lk08_availability_report",
    "sp01_temporal_split", "sp06_contiguous_kfold", "fn04_signal", "fn05_redundancy", "ff00_asof_lookup", "ff01_aggregation",
    "ff10_anomaly", "ff12_sequence", "mx02_average_precision", "mx12_metric_by_segment", "uc01_bootstrap_ci", "uc03_baseline_compare",
    "ca02_calibration_summary", "dc01_threshold_sweep", "er02_slice_errors", "mo03_drift_report", "mo10_parity_diff", "ch01_champion",
    "xp03_reason_codes", "pb03_batch_score", "dm01_woe", "dm06_attribution", "tx01_keyword_groups", "tx02_claim_trace_reports",
    "st01_daily_load",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    queries, _ = load()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
