"""S8 for a whole run: persist the result table of every (or selected) registered query.

Each result is written by the executors as parquet under ``out_dir/<key>``; nothing passes
through the driver. Returns the paths written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from washkit.plans.queries import REGISTRY
from washkit.sources.sinks import write_result


def write_results(spark: SparkSession, sf_dir: str, out_dir: str, keys: Iterable[str] | None = None,
                  *, mode: str = "overwrite") -> dict[str, str]:
    wanted = list(keys) if keys is not None else sorted(REGISTRY)
    unknown = [k for k in wanted if k not in REGISTRY]
    if unknown:
        raise KeyError(f"unknown query keys: {unknown}")
    return {k: write_result(REGISTRY[k](spark, sf_dir), out_dir, k, mode=mode) for k in wanted}
