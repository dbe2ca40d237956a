"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import stored


def _with_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge in both directions with the least neighbour of u, or u itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node reachable from each node of ``edges`` (u, v: long).

    Each round links every node's larger neighbours to its least one and then every node to its
    least smaller neighbour, until nothing changes; the edge table is written in the shared
    folder between rounds. Edges with a null end and loops are ignored; nodes in no edge are absent.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        large = _with_min(e).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct(), name)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))) \
        .groupBy("node").agg(F.min("component").alias("component"))
