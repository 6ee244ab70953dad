"""Times the headline queries and prints one JSON line.

Each query is warmed up once and then written to the no-op sink, whole result, BENCH_RUNS times;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from offerscope import plans  # noqa: E402
from offerscope.session import local_session  # noqa: E402

HEADLINE = (
    "a1_compare", "a3_coverage", "a5_gap", "a6_by_competitor", "a8_evolution", "a9_kpis", "a13_positioning", "a18_alerts",
    "n1_normalize_text", "n2_canonicalize", "j1_dedupe_quality", "j2_dedupe_cheapest", "q2_audit", "w1_simulate", "w7_page",
    "e2_rule_offers", "e5_price_groups", "f1_match_catalogue",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "offerscope-bench")
    spark.sparkContext.setLogLevel("OFF")
    registered = plans.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "offer_analytics_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
