"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from codestrata.session import build_session
from workload.queries import QUERIES

HEADLINE = (
    "file_statistics", "symbol_search", "all_symbols", "top_function_files", "repo_stats", "names_by_file",
    "recent_commits", "upsert_commits", "symbols_append", "orphan_symbols", "commit_diff", "paged_union",
    "js_block_end", "code_snippet", "py_entities", "entity_union", "index_pipeline",
    "embed_documents", "embed_collections", "knn_exact", "knn_collections", "prompts",
    "repo_context", "repo_report", "stream_ingest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["language_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_wall", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
