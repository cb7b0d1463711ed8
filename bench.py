"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with a ``noop`` write (full computation, nothing collected); the reported
time is the median of 3 runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "w4_melt_results",      # flagship: melt + record ids + running F / regret
    "a3_avg_f",
    "a9_f_series",
    "a11_latest_vs_avg",
    "a13_top_tags",
    "a15_cooccurrence",
    "f1_html_text",
    "a1_term_frequencies",
    "j3_stored_features",
    "m2_hash_features",
    "m5_node_examples",
    "m6_gradient_step",
    "m7_instance_f",
    "m11_macro_f",
    "m13_tune_thresholds",
    "m15_vote_mv",
    "j6_decode_predictions",
    "s2_page_sample",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tagstream.plans import catalog  # noqa: F401
    from tagstream.plans.registry import QUERIES
    from tagstream.session import drop_scratch, get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="tagstream-bench")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    times: dict[str, float] = {}
    for n in names:
        def once() -> float:
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up
        times[n] = round(statistics.median(once() for _ in range(runs)), 3)
        drop_scratch(spark)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
