"""Time the headline queries and print one JSON line.

Each query is built, planned and run to its last row (a write to nowhere), staging
included.  BENCH_SF_DIR names the data, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "resample_hourly", "resample_monthly", "grid_asfreq", "interpolate_linear", "outlier_thresholds", "clean_bars",
    "log_returns", "trend_table", "ewm_mean", "macd_12_26_9", "technical_indicators", "feature_table",
    "macro_month_join", "time_split", "describe_exact", "monthly_box_stats", "histogram", "acf", "seasonal_decompose",
    "adf_test", "ljung_box", "dm_test_all_pairs", "lag_feature_table", "walk_forward_frames", "naive_backtest",
    "stack_backtest", "ar_backtest", "ar_order_search", "linear_direct_backtest", "gbt_backtest",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from barloom import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()
    names = sys.argv[1:] or HEADLINES
    queries["scan_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's work
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
