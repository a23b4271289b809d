"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs ``BENCH_RUNS`` times (default 3). ``queries`` has the median;
``cold`` has the first run, which also prepares what is kept for later runs (one
graph serves any number of shots) and compiles code.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairloom.catalog.queries import QUERIES  # noqa: E402
from pairloom.session import build_session  # noqa: E402

HEADLINE = [
    "match_weight",
    "pair_dist_bounded",
    "cluster_level1",
    "critical_path",
    "level_stats",
    "edge_merge_independent",
    "shot_hits_normalized",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", int(cpus))
    seconds: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            print(f"{name} {taken[-1]:.2f}", file=sys.stderr)
        seconds[name], cold[name] = round(statistics.median(taken), 3), round(taken[0], 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
