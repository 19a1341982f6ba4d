"""Benchmark: headline catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
  {"metric": "median_query_seconds_sum", "value": N, "unit": "sec",
   "queries": {"name": sec, ...}, "sf": "...", ...}

Each query is forced with a no-op write (every row computed, nothing
collected).  ``cold`` is its first run, with nothing remembered: it also
builds the shared inputs (parsed corpus, fitted vectors, co-occurrence
windows).  ``queries`` holds the median of the runs after it, which find
those inputs as tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_blocks", "doc_table", "top_words", "tfidf_vocab", "sim_p95", "doc_graph",
    "bridges", "network_edges", "npmi_edges", "word_graph", "lexicon_scores",
    "topic_summary", "class_tfidf", "word_sizes", "silhouette_clusters", "embedding_knn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    mem = os.environ.get("BENCH_MEM", "6g")
    names = sys.argv[1:] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))

    from lexigraph.plans import catalogue as C
    from lexigraph.session import checkpoint_dir, get_spark

    spark = get_spark(cpus, max(8, 2 * cpus), app="lexigraph-bench", memory=mem)
    checkpoint_dir(spark)
    out: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats + 1):
            if not runs:
                C.forget()  # the first run builds what the query needs (corpus, vectors, windows)
            t = time.time()
            C.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        cold[name], out[name] = round(runs[0], 3), round(statistics.median(runs[1:]), 3)
        print(f"# {name}: cold {cold[name]}s, warm {out[name]}s", file=sys.stderr, flush=True)

    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "median_query_seconds_sum", "value": total, "unit": "sec",
                      "queries": out, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
