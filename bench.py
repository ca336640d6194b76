"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: the data folder; BENCH_CPUS: local cores; BENCH_QUERIES: names, or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time

from sitequill.queries import QUERIES
from sitequill.session import local_session

HEADLINE = [
    "published_topn",
    "lookup_by_slug",
    "counts_by_type",
    "clean_text",
    "excerpt",
    "index_entries",
    "site_index",
    "index_listing",
    "md_tables",
    "md_lists",
    "html_to_markdown",
    "page_documents",
    "safe_markup",
    "custom_agents",
    "agent_activity",
    "client_ip",
    "peers_in_ranges",
    "limit_fixed",
    "limit_refresh",
    "redirects",
    "outcomes",
    "stale_keys",
    "rebuild_set",
    "stream_limit_fixed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else (chosen.split() or HEADLINE)
    spark = local_session(cpus, partitions=cpus)
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
