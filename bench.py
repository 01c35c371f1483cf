"""Time the headline queries: one warm-up, then the median of three runs.

Prints one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and
cores; query names given as arguments replace the default list.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "sr_bm25", "sr_bm25_index", "sr_index_build", "top_vec_20", "sr_hybrid_rrf", "sr_multi_corpus", "sr_context",
    "job_chunk_corpus", "fn_formula_extract", "fn_unreadable", "job_lint", "fn_tokenize",
    "jn_chunk_toc", "jn_page_chapter", "jn_solution_link", "jn_solution_resolve", "jn_exercise_term",
    "job_build_curriculum", "win_toc_page_end", "win_moving_latency", "rate_limit_batch",
    "agg_facets", "agg_corpus_metrics", "agg_page_manifest", "agg_benchmarks", "agg_term_counts",
    "job_enqueue", "job_reingest_scope", "job_requalify",
]


def main() -> None:
    from foliospark.catalog import load
    from foliospark.catalog.tables import Tables
    from foliospark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 8)))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cpus)
    registry = load()
    tables = Tables(spark, sf_dir, tasks=int(cpus))
    spent: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name].run(tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        spent[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {spent[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
