"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8), BENCH_RUNS the
timed runs per query after one warm run (default 2); the fastest one counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship_price_anomalies",  # history split, wide aggregate, quartiles, fusion, top-k
    "d05_baseline_cache",        # the aggregation job
    "d12_trend_features",        # ranked windows per product
    "e13_market_compare",        # two-level aggregate over market keys
    "e15_rapid_drop",            # sliced lag and trailing count
    "r02_first_rule_match",      # rule table over all prices
    "r08_deal_detect",           # stateless deal detection
    "f04_knn_cosine",            # blocked exact neighbours
    "g01_alert_dedupe",          # ordered fold
    "g06_recent_signal_antijoin",  # range conditions as an equi join
    "i01_store_health",          # last-100 health and failure runs
    "i13_metric_increase",       # tumbling and sliding windows
    "b10_tokens",                # text at scale
    "p03_page_analysis",         # page patterns
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    from driftmark.plans import registry
    from driftmark.session import build_session

    registry.load()
    spark = build_session(
        "driftmark-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
