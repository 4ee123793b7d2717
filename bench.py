"""Times of the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "api_counts", "family_counts", "focus_window", "hotspots", "opcode_table", "burst_count", "carrier_rank",
    "entropy", "token_scan", "digest_universe", "derivation_match", "lineage_closure", "bigrams", "loops",
    "call_tree_links", "dag_edges", "registry_resolve", "string_leaves", "dq_causality", "capture_gate",
)


def main() -> None:
    from traceframe.plans import load_queries
    from traceframe.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load_queries()
    # Class loading and the Python workers are not what is measured.
    queries["api_counts"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
