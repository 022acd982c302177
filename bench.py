"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fadewatch.session import local_session  # noqa: E402

HEADLINE = [
    "cycle_signals", "end_of_life_label", "spike_filter", "gap_fill_by_windows", "running_median", "voltage_at_fraction", "slope_peak",
    "feature_set_a", "feature_set_b", "feature_set_c", "feature_set_d", "stratified_folds", "repeated_folds", "bootstrap_rmse_interval",
    "regression_metrics", "grouped_quantiles", "average_precision", "recall_cutoffs", "fail_pass_sets", "policy_summary", "linear_out_of_fold",
    "stack_weights", "sign_consistency", "group_importance_by_horizon", "maintenance_report",
]


def main() -> None:
    from fadewatch.plans.catalog import REGISTRY

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf}/region.parquet").groupBy("r_regionkey").count().collect()  # the session's start is not a query's time
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        REGISTRY[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
