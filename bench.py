"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query is
run to completion into the no-op sink, so every output column is computed; the first of
the runs warms up and is not counted.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from larder.plans.registry import QUERIES
from larder.session import build_session

HEADLINE = (
    "stock_health",
    "active_alerts",
    "reorder_recommendations",
    "location_performance",
    "category_heatmap",
    "inventory_summary",
    "abc_cost_stats",
    "inventory_anomalies_long",
    "demand_forecast_long",
    "generate_alerts",
    "generate_reorders",
    "inventory_changes",
    "cleaned_inventory",
    "stock_projection",
    "trend_stock_long",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
