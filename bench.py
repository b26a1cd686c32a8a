"""Headline queries, timed one after the other. Prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (optional,
comma separated) the queries.
"""

from __future__ import annotations

import json
import os
import time

from pathloom import catalog
from pathloom.session import local_session

HEADLINE = [
    "latest_sequence_summary", "build_inventory", "compact_inventory", "keep_latest_ties",
    "keep_latest_two_stage_time", "delete_by_keys", "summarize_sequences", "frame_ranges_hot",
    "assign_shot", "expand_templates", "provision_links", "version_duplicates", "snapshot_diff",
    "review_status", "sum_by_layer_frame", "parse_farm_jobs", "nested_paths", "tree_edges",
    "prefix_duplicates", "instance_inventory",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the session is no part of any query
    spark.read.parquet(f"{sf}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
