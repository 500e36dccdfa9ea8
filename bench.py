"""Headline queries on local cores; prints one JSON line.

Each query runs twice and the faster run counts, so start-up of the JVM and
of Python workers is left out.  ``pages_per_second`` is the rate of the full
page extraction.
"""

from __future__ import annotations

import json
import os
import time

from pagemill.registry import all_queries
from pagemill.session import local_session

HEADLINE = (
    "domain_page_summary", "page_content", "page_content_tree", "page_links", "links_by_domain", "url_canonical_key",
    "url_valid", "clean_text", "content_hash", "fuzzy_features", "dedup_keep_first", "dedup_verdict", "dedup_stats",
    "dedup_greedy", "robots_allowed", "frontier_heads", "polite_plan", "one_hop_new_links", "crawl_depth", "crawl_summary",
    "errors_by_type", "response_histogram", "response_percentiles", "progress_30s", "content_lookup", "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "pages_per_second": round(pages / times["page_content"], 1),
    }))


if __name__ == "__main__":
    main()
