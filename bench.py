"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestar import queries  # noqa: E402
from lodestar.session import session  # noqa: E402

HEADLINE = [
    "vector_topk_l2", "vector_topk_cosine", "batch_vector_topk", "binary_rerank", "lexical_topk", "rrf_hybrid", "hybrid_mmr", "chunk_window", "chunk_recursive",
    "entity_stats", "relation_stats", "degree_both", "search_nodes", "neighbors_both", "bfs_distance", "fulltext", "html_to_text", "json_to_text", "ingest_dedup", "store_ingest", "stored_search",
]
REPEATS = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median_low(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
