"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text", "language_profile", "semantic_intent", "route", "structure_elements", "section_tree",
    "split_sections", "sliding_chunks", "fixed_chunks", "recursive_chunks", "incremental_diff", "judge_chunks",
    "filter_report", "near_duplicates", "unique_documents", "sparse_index", "bm25", "bm25_sources", "exact_knn",
    "rrf", "rerank", "build_context", "context_expansion", "extract_relations", "multi_hop",
    "latency_percentiles", "daily_series", "ab_test", "user_sessions", "rate_violations_sliding", "stream_throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from docloom.plans.catalog import QUERIES
    from docloom.plans.tables import Tables
    from docloom.session import local_session

    spark = local_session(cpus)
    Tables.spread = int(cpus)
    for name in ("documents", "events"):  # start the executors and the file cache
        spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
