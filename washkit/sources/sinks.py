"""Sinks (S7, S8): persist any result DataFrame, written by the executors in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", single_file: bool = False) -> str:
    """Header CSV export of a result.

    ``single_file=True`` coalesces to one part file -- only for small, chart-sized results;
    large results keep one part file per partition.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def write_result(df: DataFrame, base_dir: str, name: str, *, mode: str = "overwrite",
                 partition_by: Sequence[str] | None = None) -> str:
    """The table behind a chart, as parquet under ``base_dir/name`` (optionally partitioned,
    e.g. by ``year``, so later reads prune partitions)."""
    path = f"{base_dir.rstrip('/')}/{name}"
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    """S8 for some periods only: the partitions that ``df`` has rows of are replaced as a whole, all
    others keep their files (dynamic partition overwrite). Writing the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    return path
