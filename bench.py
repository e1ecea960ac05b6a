"""Time the headline queries and print one JSON line."""

import json
import os
import time

from codeatlas.plans.catalog import QUERIES
from codeatlas.session import local_session

HEADLINE = ["hubs", "graph_stats", "batch_callers", "surprising_connections", "bfs_depth", "weighted_path", "pagerank", "change_coupling", "provenance", "bm25_search", "dense_knn", "hybrid_rrf", "exact_clones", "normalize_url", "tool_stats", "recovery_latency", "module_density", "lineitem_cube"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["graph_stats"](spark, sf_dir).collect()  # compiles and warms the session
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
