"""Times the headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("substring_search", "bm25_search", "refs", "refs_breakdown", "identifier_index", "callers", "callees", "transitive_callers", "impact", "path_hops", "deps_edges", "file_outline", "changed_symbols", "incremental_plan", "code_tokens", "token_stats")


def main() -> None:
    from lexiloom.plans.catalog import QUERIES
    from lexiloom.session import get_spark

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["stats_kind"](spark, sf).collect()  # starts the JVM's machinery
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
