"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or `all` (default: the headline queries)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "list_objects_classified",
    "footprint",
    "latest_backup",
    "backup_list_detail",
    "delete_retain_summary",
    "delete_before",
    "delete_pages",
    "empty_dirs",
    "wal_gaps",
    "wal_islands",
    "missing_segments",
    "backup_covered",
    "restore_point",
    "incomplete_backups",
    "compression_ratio",
    "volume_pack",
    "manifest_filter",
    "pending_oldest",
    "status_reconcile",
    "inventory_diff",
    "log_parse",
    "upload_stats",
    "stream_throughput",
    "log_records",
]


def main():
    from tidemark.plans.registry import QUERIES
    from tidemark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.perf_counter()
        QUERIES[name][1](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("backup_list")  # start the JVM's and Python's machinery before the clock counts
    first = {name: run(name) for name in names}
    # The second round tells apart what a query costs and what its first compilation costs; the lesser of both is reported.
    times = {name: min(first[name], run(name)) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time, better of two runs each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
