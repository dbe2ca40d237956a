"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are the items. Large groups are items of the final packing; small ones are
first packed, cell by cell, into bundles of a fixed small fraction of a shard, and bundles again
while there are many, so the final packing sees a bounded number of items whatever the input.
Both packings take items by falling size and put each into the bin with the tightest remaining
capacity that holds it, found in a residual-ordered tree. The final packing searches the least
shard capacity at which the wanted number of shards suffices; a group that is larger than an
equal share of what is left gets a shard of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washkit.llm.common import stored, utf8

#: A bundle is this part of an equal shard; the final packing has at most about four times as many
#: items for each shard.
FINENESS = 1024
#: Expected groups of a cell.
CELL = 4096


def best_fit(weights: list[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """Bin of each weight (given in falling order), or None where ``bins`` bins don't hold them."""
    tree: list[tuple[int, int]] = []  # (remaining capacity, bin), ordered
    out, used = [], 0
    for w in weights:
        at = bisect_left(tree, (w, -1))
        if at < len(tree):
            left, b = tree.pop(at)
        elif bins is not None and used == bins:
            return None
        else:
            left, b, used = max(capacity, w), used, used + 1
        insort(tree, (left - w, b))
        out.append(b)
    return out


def pack_shards(weights: list[int], shards: int) -> list[int]:
    """Shard of each weight (given in falling order), sizes as equal as the weights allow."""
    out, total = [], sum(weights)
    while shards - len(out) > 1 and len(out) < len(weights) and weights[len(out)] * (shards - len(out)) >= total:
        total -= weights[len(out)]
        out.append(len(out))
    own = len(out)
    rest, bins = weights[own:], shards - own
    if not rest:
        return out
    low = max(rest[0], -(-total // bins))
    high = total // bins + rest[0]
    best = best_fit(rest, high, bins)
    while best is None:
        high += rest[0] + 1
        best = best_fit(rest, high, bins)
    while low < high:
        mid = (low + high) // 2
        found = best_fit(rest, mid, bins)
        if found is None:
            low = mid + 1
        else:
            high, best = mid, found
    return out + [own + b for b in best]


def _bundles(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values(["w", "item"], ascending=[False, True])
        pdf["bundle"] = best_fit(pdf["w"].tolist(), capacity)
        return pdf[["item", "w", "cell", "bundle"]]

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", fineness: int = FINENESS, cell: int = CELL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    size: the text's UTF-8 bytes (null: none) plus 8. Rows with equal texts share a shard (null
    counts as empty). slot numbers a shard's rows from 0 without gaps. Law ``bytes``: shard sizes
    are near equal; grown_shard is null. Null and repeated ids are rows like any other; an empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = utf8(text_col)
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                              F.unhex(F.md5(text)).alias("text_id"), F.monotonically_increasing_id().alias("row")), "rows")
    groups = stored(rows.groupBy("text_id", "text_crc32").agg(F.sum("size").alias("w")).withColumn("item", F.monotonically_increasing_id()), "groups")
    total, n = groups.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count("*")).first()
    capacity = max(1, int(total) // (shards * fineness))
    placed = groups.select("text_id", "text_crc32", "item")  # group -> its current item
    items = groups.select("item", "w")
    large = items.where(F.col("w") > capacity)
    small = items.where(F.col("w") <= capacity)
    while True:
        n = small.count()
        if n <= 2 * shards * fineness:
            break
        cells = -(-n // cell)
        packed = stored(small.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(cells)), F.lit(cells))).groupBy("cell")
                        .applyInPandas(_bundles(capacity), "item long, w long, cell long, bundle long")
                        .withColumn("into", F.xxhash64("cell", "bundle", F.lit(cells))), "bundles")
        placed = placed.join(packed.select("item", "into"), "item", "left").select("text_id", "text_crc32", F.coalesce("into", "item").alias("item"))
        small = stored(packed.groupBy(F.col("into").alias("item")).agg(F.sum("w").alias("w")), "bundled")
        if small.count() * 2 > n:  # bundles are full: no further pass makes them fewer
            break
    final = sorted(((r[1], r[0]) for r in large.unionByName(small).collect()), key=lambda x: (-x[0], x[1]))
    where = pack_shards([w for w, _ in final], shards)
    found = spark.createDataFrame([(item, s) for (_, item), s in zip(final, where, strict=True)], "item long, shard int")
    of_text = placed.join(found, "item").select("text_id", "text_crc32", "shard")
    out = stored(rows.join(of_text, ["text_id", "text_crc32"]).select("doc_id", "size", "text_crc32", "shard", "row"), "sharded")
    return numbered(out, rows.count())


def numbered(out: DataFrame, n: int, cell: int = 50_000) -> DataFrame:
    """Slots from 0 in each shard: numbers inside cells of bounded size, plus the rows of the cells before."""
    cells = max(1, -(-n // cell))
    dealt = out.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    sizes = dealt.groupBy("shard", "cell").agg(F.count("*").alias("c"))
    before = sizes.select("shard", "cell", (F.sum("c").over(Window.partitionBy("shard").orderBy("cell")) - F.col("c")).alias("before"))
    local = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "row"))
    return dealt.withColumn("local", local).join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("local") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
