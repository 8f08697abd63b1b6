"""Time the headline queries: one JSON line with seconds per query (warm run, results written to a no-op sink)."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from fleetloom.plans.registry import registered

HEADLINE = [
    "option_usage",
    "usage_summary",
    "workspace_view",
    "service_urls",
    "effective_mounts",
    "container_usage",
    "event_owner",
    "pvc_workspaces",
    "mount_blocked",
    "content_hashes",
    "last_warning",
    "gpu_by_namespace",
    "text_filter",
    "sort_workspaces",
    "evaluate_filter_rules",
    "evaluate_filter_rules_stored",
    "list_option_values",
    "admit_create",
    "pause_decision",
    "claim_audit",
    "mount_path_audit",
    "resource_audit",
    "reconcile_plan",
    "map_drift_replace",
    "membership_diff",
    "normalise_quantities",
    "resolve_redirects",
    "derive_state",
    "running_since",
    "fold_probes",
    "escalations",
    "log_tail",
    "stream_activity",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    queries, spark, seconds = registered(), session(), {}
    for name in names:
        best = None
        for attempt in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if attempt:
                best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
