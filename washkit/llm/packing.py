"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are cut into pieces of at most the sequence length and dealt over cells of bounded
size. In a cell, pieces enter by falling length the tightest bin that holds them and has neither
their source nor their duplicate cluster: bins are ordered by residual, each carries one bitmap
of sources and one of clusters, and the search goes on to the next larger residual until a bin
is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import stored

#: Words of a sequence, expected pieces of a cell.
CAPACITY, CELL = 1024, 2048


def pack_cell(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, slot) of each piece, given in falling size. Sources and clusters are small numbers,
    below 0 where there is none."""
    tree: list[tuple[int, int]] = []  # (residual, bin), ordered
    has_source: list[int] = []
    has_cluster: list[int] = []
    count: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        for at in range(bisect_left(tree, (size, -1)), len(tree)):
            b = tree[at][1]
            if not (has_source[b] & s or has_cluster[b] & c):
                left = tree.pop(at)[0]
                break
        else:
            b, left = len(count), capacity
            has_source.append(0)
            has_cluster.append(0)
            count.append(0)
        insort(tree, (left - size, b))
        has_source[b] |= s
        has_cluster[b] |= c
        out.append((b, count[b]))
        count[b] += 1
    return out


def _packed(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values(["n_words", "doc_id", "row", "part"], ascending=[False, True, True, True])
        codes = [pdf[c].factorize()[0].tolist() for c in ("source", "cluster")]
        found = pack_cell(pdf["n_words"].tolist(), *codes, capacity)
        pdf["bin"] = [(int(k) << 24) + b for k, (b, _) in zip(pdf["cell"], found, strict=True)]
        pdf["slot"] = [s for _, s in found]
        return pdf[["row", "part", "bin", "slot"]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None,
         capacity: int = CAPACITY, cell: int = CELL, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, part, first_word, n_words, bin, slot) of every piece of every row of ``docs``.

    Words are parted by ASCII white space. A document of more than ``capacity`` words is cut into
    parts of that many and a rest. No bin holds more than ``capacity`` words, two documents of one
    source, or two of one duplicate cluster: ``cluster_col``, else the cluster that ``clusters`` (id,
    cluster) gives the row's id, else equal texts but for letter case. A null source or cluster conflicts with nothing. A null or wordless text is one
    part of no words with a null bin and slot. Null and repeated ids are rows like any other.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cluster = F.xxhash64(F.lower(text)) if cluster_col is None else F.col(cluster_col)
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
        F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster")), "lengths")
    if clusters is not None and cluster_col is None:
        given = clusters.where("id IS NOT NULL AND cluster IS NOT NULL").groupBy(F.col("id").alias("doc_id")).agg(F.concat(F.lit("c"), F.min("cluster").cast("string")).alias("given"))
        rows = rows.join(given, "doc_id", "left").withColumn("cluster", F.coalesce("given", "cluster")).drop("given")
    parts = F.greatest(F.ceil(F.col("words") / capacity), F.lit(1))
    pieces = rows.select("row", "doc_id", "words", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    pieces = pieces.select("row", "doc_id", "source", "cluster", "part", (F.col("part") * capacity).alias("first_word"),
                           F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("part") * capacity).alias("n_words"))
    filled = pieces.where("n_words > 0")
    cells = max(1, -(-filled.count() // cell))
    found = filled.withColumn("cell", F.pmod(F.xxhash64("row", "part"), F.lit(cells))) \
        .select("cell", "row", "doc_id", "part", "n_words", "source", "cluster") \
        .groupBy("cell").applyInPandas(_packed(capacity), "row long, part long, bin long, slot long")
    return pieces.join(found, ["row", "part"], "left").select("doc_id", F.col("part").cast("int").alias("part"), "first_word", "n_words", "bin", F.col("slot").cast("int").alias("slot"))
