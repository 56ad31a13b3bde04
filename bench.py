"""Headline timings.  Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run in full into a no-op sink: once cold, then warm; the warm
time is the reported one.  Building the plan is part of the time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioworks import registry  # noqa: E402
from folioworks.session import build_session  # noqa: E402

HEADLINE = [
    "textual_search", "local_answer", "document_listing", "status_summary", "sources_summary", "source_dashboard",
    "topic_counts", "visible_documents", "smart_chunks", "fixed_chunks", "indexing_estimate", "all_terms_match",
    "cover_density_rank", "nearest_vectors", "nearest_vectors_batch", "hybrid_search", "pair_verdicts",
    "duplicate_decisions", "parsed_pages", "regex_content", "scripture_references", "upserted_documents",
    "rate_limit_windows", "accepted_requests", "cache_lookups", "segment_revenue",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "1m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    entries = registry.load()

    def once(name: str) -> float:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    wanted = sys.argv[1:] or HEADLINE
    cold = {name: round(once(name), 3) for name in wanted}
    warm = {name: round(once(name), 3) for name in wanted}
    print(json.dumps({
        "metric": "headline query seconds, warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
