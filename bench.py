"""Run the headline queries and print one JSON line with their times."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_topk", "bm25_evaluation", "dense_topk", "text_dense_topk", "weighted_fusion", "maxsim_topk",
    "word_windows", "sentence_chunks", "word_bags", "processor_formulas", "clean_html", "query_intents",
    "chunk_size_sweep", "product_quantization", "upserted_chunks", "collection_catalog", "daily_latency", "cache_lookup", "request_limiter", "event_rates", "stream_daily_counts",
]


def main() -> None:
    from corpusflow.plans.registry import load_all
    from corpusflow.session import local_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    catalog = load_all()
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before the clock
    times = {}
    for name in names:
        catalog[name].job(spark, root).write.format("noop").mode("overwrite").save()  # compiled code and file cache, as on a running cluster
        started = time.time()
        catalog[name].job(spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
