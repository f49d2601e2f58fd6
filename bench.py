"""Headline-query benchmark: prints one JSON line with per-query wall seconds.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to completion with the ``noop`` sink (all rows computed, none
collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlark.plans import registry  # noqa: E402
from ledgerlark.session import build_session  # noqa: E402

HEADLINE = [
    "clean_loans", "monthly_volume", "grade_pivot", "null_profile", "prepare_transactions", "forecast_uncertainty",
    "rolling_backtest", "training_frame", "rfm_scores", "pareto_wealth", "behavioral_anomalies", "regional_intelligence",
    "deposit_rule_flags", "drift_report", "eval_classification", "correlation_matrix", "stress_scenario",
    "stream_hourly_trend", "persona_kmeans", "reconstruction_error",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="ledgerlark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    # warm-up: JVM start, class loading and the first Parquet footer reads
    registry.QUERIES["monthly_volume"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.perf_counter()
        df = registry.QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
