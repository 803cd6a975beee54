"""Headline timings: prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quantloom.catalog import load
from quantloom.session import local_session

HEADLINE = [
    "s01_parquet_scan", "j01_asof_fundamentals", "f05_signal_matrix", "f06_composite_score", "a08b_table_quantile",
    "q00_momentum_slice", "o15_walk_forward", "o20_metric_pack", "r07_stress_test", "r08b_stress_distribution", "r10_composite_regimes",
    "r14_rolling_forecast", "r16b_monte_carlo_factor", "m04_ledoit_wolf", "m01_elastic_net_forecast", "o02_mean_variance", "b02_metric_intervals", "b07_fan_chart",
    "b08_alpha_significance", "h08_overlay_backtest", "x03_trial_fold_metrics", "x09_overfitting_probability",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before timing
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
