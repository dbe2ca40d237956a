"""Benchmark the registered queries.

Runs every query key of ``washkit.plans.queries`` on ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``: one warm-up run,
then the median of ``$BENCH_REPEATS`` (default 3) timed runs. Each run executes
the whole plan into Spark's ``noop`` sink (no collect to the driver). Prints one
JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.01 python bench.py [key ...]
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from washkit.plans.queries import REGISTRY
    from washkit.session import get_spark

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))
    spark = get_spark(f"local[{cpus}]", app="washkit-bench", shuffle_partitions=parts,
                      driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    keys = sys.argv[1:] or sorted(REGISTRY)
    times: dict[str, float] = {}
    for k in keys:
        def run() -> float:
            t0 = time.perf_counter()
            REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()  # warm-up
        times[k] = round(statistics.median(run() for _ in range(repeats)), 4)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus),
        "repeats": repeats,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
