"""Benchmark of the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and
prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is run to completion through the no-op sink (all rows produced,
nothing collected to the driver).

Before timing, every query runs once on the smallest scale factor: the plans
are the same, so Spark's generated code is compiled and the JVM is warm, and
the timed run measures the data-dependent work (a long job at scale pays those
fixed costs once). The warm-up time is reported separately ("warmup_sec").
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "common_tags",
    "tag_cooccurrence",
    "tag_distance_matrix",
    "salience_matrix_full",
    "mantel_pearson",
    "experiment",
    "experiment_grid",
    "twin_distance_matrix",
    "pair_dataset",
    "pair_split",
    "pair_similarity_eval",
    "hash_embeddings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tagspace.session import local_session
    n = int(cpus) if cpus.isdigit() else os.cpu_count() or 8
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * n), driver_memory="16g",
                          app="tagspace-bench")
    from tagspace.catalog import QUERIES
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    t0 = time.perf_counter()
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - t0, 3)
    times = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "warmup_sec": warmup,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
