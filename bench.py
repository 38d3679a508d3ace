"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then timed in full (plan building and any job it
starts included).  Three plans are also timed next to the loop they replace.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from registry import load  # noqa: E402
from registry.common import scored_items  # noqa: E402
from registry.drifting import ITEM_FEATURES, item_sides  # noqa: E402
from riskloom.operators import classifier, drift, sweep  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "features_notebook", "batch_decisions", "order_line_decisions", "prediction_summary", "clean_clients", "describe_order_lines",
    "duplicate_rows", "rejected_rows", "classification_metrics", "order_line_metrics", "order_line_sweep_99",
    "threshold_sweep_90", "threshold_rules", "roc_curve_corners", "curve_areas", "calibration_error", "histograms_30",
    "correlation_matrix", "segment_default_rates", "csi_order_lines", "csi_all_features", "two_sample_ks_order_lines",
    "drift_report", "proxy_monitors_by_month", "performance_gates_by_month", "stratified_split_sizes", "fold_stability",
    "bootstrap_intervals_order_lines", "fairness_by_age", "suppressed_repeats", "rate_limited_alerts", "escalations",
    "latency_report_per_day", "stream_error_rates",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def loops(spark: SparkSession) -> dict[str, float]:
    """One-pass plans against one job per threshold or feature."""
    items = scored_items(spark, FOLDER)
    reference, production = item_sides(spark, FOLDER)
    some = sweep.HUNDREDTHS[::10]
    return {
        "sweep_10_one_scan": timed(lambda: run(sweep.sweep(items, some))),
        "sweep_10_loop": timed(lambda: [run(classifier.confusion(items, t)) for t in some]),
        "csi_4_one_job": timed(lambda: run(drift.csi(reference, production, ITEM_FEATURES))),
        "csi_4_loop": timed(lambda: run(reduce(
            DataFrame.unionByName, [drift.psi(reference, production, f) for f in ITEM_FEATURES]
        ))),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    known = load()[0]
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINES:
        known[name](spark, FOLDER).limit(1).collect()  # warm-up
        times[name] = timed(lambda: run(known[name](spark, FOLDER)))
    compared = {} if sys.argv[1:] else loops(spark)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "plans": compared, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
