"""Time the headline queries over whole tables and print one JSON line.

The supplied tables are one row group each, which one task reads; a cluster's tables are many files.
So they are first dealt into as many files as there are cores, which is not timed: the plans are
those that run at scale, without a shuffle to spread a scan. Each query is then run into a no-op
sink (every row and column is computed, nothing is collected) once to warm up and three times for
the median.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from capture_analytics import build_session
from capture_analytics.plans import PLANS

HEADLINE = (
    "repeated_captures", "url_canonicalize", "url_unwrap", "listing_resolution",
    "login_wall", "extraction_validate", "tier_cascade", "link_dedup", "company_resolve",
    "score_batch", "post_applications", "rel_counts", "search_posts", "sort_page", "apply_patch",
    "probation_runs", "probation_fold", "host_outcomes", "trace_order", "trace_path",
    "trace_conformance", "lineage_chain", "latest_status", "history_budget", "history_repair",
    "tool_call_pairing", "usage_by_agent", "page_text", "page_links", "apply_candidates",
    "selector_check", "capture_class",
)
RUNS = 3


def dealt(spark, folder: str, files: int, to: str) -> str:
    """The tables of a folder, each as so many files."""
    for table in sorted(Path(folder).glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(files).write.parquet(f"{to}/{table.name}")
    return to


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    own = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": f"{own.name}/shared",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    with own:
        folder = dealt(spark, given, int(cpus), own.name)
        for name in HEADLINE:
            taken = []
            for _ in range(RUNS + 1):
                started = time.perf_counter()
                PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - started)
            seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": given.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus), "runs": RUNS}))


if __name__ == "__main__":
    main()
