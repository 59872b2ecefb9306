"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local threads. Each
query is built and run to the end without keeping its rows; the session is warmed up
before the clock starts.
"""

from __future__ import annotations

import json
import os
import time

from steward.registry import QUERIES
from steward.session import local_session

HEADLINE = [
    "under_replicated_ranked",
    "provider_counts",
    "catalog_lookup",
    "by_status",
    "older_than",
    "page",
    "find_added",
    "reconcile",
    "snapshot_diff",
    "fold_changes",
    "latest_line",
    "manifest_fields",
    "upsert",
    "remove",
    "attach_sizes",
    "fit_capacity",
    "fit_capacity_prefix",
    "adder_outcomes",
    "rebalance",
    "verify_catalog",
    "sync_incremental",
    "usage_report",
    "verify_blocks",
    "sweep",
    "sweep_tree",
    "swap_plan",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("steward-bench", os.environ.get("BENCH_CPUS", "8"))
    for name in ("under_replicated_ranked", "fit_capacity"):
        run(spark, name, folder)
    seconds = {name: run(spark, name, folder) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
