"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once on the clock; the clock covers everything from building the
query to the last result row.
"""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ["keyword_search", "phrase_matches", "phrase_lookup", "semantic_search", "routed_search",
            "vector_search", "text_vectors", "company_timeline", "related_parties", "entity_dossier",
            "notice_lookup", "filtered_notices", "build_notices", "upserted_notices",
            "rule_annotations", "stats_document", "window_hits", "rate_decisions", "run_summary",
            "stream_window_hits"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE

    from noticeboard.catalog.queries import QUERIES
    from noticeboard.session import build_session
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in names:
        run(name)
        times[name] = round(run(name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
