"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2: the first warms up,
the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from labelspark.plans import registry
from labelspark.session import local_session

HEADLINE = [
    "extract_mrp", "extract_net_quantity", "extract_manufacturer", "extract_nutrition", "tokens_to_lines",
    "ensemble_status", "scan_verdicts", "rule_results", "catalog_lookup", "scan_list", "dashboard", "product_list",
    "apply_review_actions", "flag_audit", "suppress_overlaps", "limit_attempts_day",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries, times = registry.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - started)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
