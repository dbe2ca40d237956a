"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has, in each of several trees, a string of random-hyperplane bits; a tree is the
sorted array of its strings. A query descends in every tree to its longest prefix match by binary
search, then all trees ascend together, one prefix bit at a time, until enough candidates are
met. The index is dealt over blocks of bounded size, each a forest that is built once, and the
queries stream through every one; a block returns each query's best, and the best of all blocks
are the answer. Candidates are scored exactly, by cosine in double precision. With ``share=1`` a
query meets every vector of a block, so the answer is exact: the way for data without structure
that a hash could find, or wherever the recall measured is too low.

Vectors that are equal get equal strings in all trees; they are met together, and each is scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washkit.llm.common import stored

TREES, BITS = 48, 32
#: Expected vectors of an index block.
BLOCK = 4096
#: Candidates (distinct) that a query meets in a block before the trees stop ascending, as a share of the block.
SHARE = 0.6


def planes(dims: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, trees * bits))


def strings(x: np.ndarray, normals: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(rows, trees) hash strings as unsigned numbers whose first bit is the highest."""
    signs = (x @ normals > 0).reshape(len(x), trees, bits)
    return signs @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))


class Forest:
    """Sorted arrays of the hash strings of one block of vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.normals, self.bits, self.n = planes(x.shape[1], trees, bits), bits, len(x)
        codes = strings(x, self.normals, trees, bits)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query, prefix length (from none to all bits) and tree: the range of the sorted
        array that shares the prefix."""
        codes = strings(q, self.normals, self.codes.shape[1], self.bits)
        shifts = np.arange(self.bits, -1, -1, dtype=np.uint64)
        low = codes[:, None, :] >> shifts[None, :, None] << shifts[None, :, None]
        high = low + (np.uint64(1) << shifts)[None, :, None]
        first, last = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        for t in range(self.codes.shape[1]):
            first[:, :, t] = np.searchsorted(self.codes[:, t], low[:, :, t])
            last[:, :, t] = np.searchsorted(self.codes[:, t], high[:, :, t])
        return first, last

    def candidates(self, first: np.ndarray, last: np.ndarray, wanted: int) -> np.ndarray:
        """Rows met by one query when at least ``wanted`` different ones are met, or all."""
        sizes = (last - first).sum(axis=1)
        level = max(0, int(np.searchsorted(-sizes, -wanted, side="right")) - 1)  # the deepest with as many entries, repeats counted
        met = np.zeros(self.n, np.bool_)
        for depth in range(level, -1, -1):  # synchronous ascent
            for t in np.flatnonzero(last[depth] > first[depth]):
                met[self.order[first[depth, t] : last[depth, t], t]] = True
            found = np.flatnonzero(met)
            if len(found) >= min(wanted, self.n):
                break
        return found


def cosines(x: np.ndarray, norms: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    return (x * q).sum(axis=1) / (norms * norm)


def _searched(k: int, share: float):
    """Rows (b, dims, asked, vec_id, embedding) in this order: a block's vectors, then the queries that
    visit it -> (query_id, vec_id, score) of each query's best in the block. Only the block is held."""

    def run(batches):
        import pyarrow as pa

        block, ids, rows = None, [], []
        forest = x = norms = known = None

        def answered(qids: np.ndarray, q: np.ndarray):
            out = []
            for s in range(0, len(q), 64):
                first, last = forest.bounds(q[s : s + 64])
                for i in range(len(first)):
                    j = s + i
                    met = forest.candidates(first[i], last[i], max(16 * k, int(share * len(known))))
                    met = met[known[met] != qids[j]]
                    score = cosines(x[met], norms[met], q[j], float(np.sqrt((q[j] * q[j]).sum())))
                    best = np.lexsort((known[met], -score))[:k]
                    out.append((np.full(len(best), qids[j]), known[met][best], score[best]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            at, dims, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "dims", "asked"))
            cut = np.r_[0, np.flatnonzero((np.diff(at) != 0) | (np.diff(dims) != 0) | (np.diff(asked) != 0)) + 1, len(at)]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                values = part.column("embedding").flatten().to_numpy().reshape(e - s, int(dims[s]))
                if block != (at[s], dims[s]):
                    block, ids, rows, forest = (at[s], dims[s]), [], [], None
                if not asked[s]:
                    ids.append(part.column("vec_id").to_numpy())
                    rows.append(values)
                elif rows:
                    if forest is None:
                        known, x = np.concatenate(ids), np.concatenate(rows)
                        norms, forest = np.sqrt((x * x).sum(axis=1)), Forest(x)
                    yield answered(part.column("vec_id").to_numpy(), values)

    return run


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding as doubles, dims) of the vectors that take part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    ok = F.forall(F.col("embedding"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(F.col("embedding"), lambda v: v != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))) \
        .withColumn("dims", F.size("embedding"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK,
            share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of ``vectors`` but itself.

    ``queries`` has the columns of ``vectors``. Vectors and queries that are null, empty, zero, or
    hold null or non-finite components take no part, nor do those with a null id; vectors are met
    by queries of their own length only. Ties go to the smaller id; of rows that repeat an id and
    a vector one is used. Fewer than ``k`` candidates are all returned. ``share=1`` is exact. Other
    columns are not read. A vector is shuffled once, a query once for each block.
    """
    rows = stored(valid(vectors, id_col, vec_col).dropDuplicates(["vec_id", "embedding"]), "vectors")
    asked = stored(valid(queries, id_col, vec_col).dropDuplicates(["vec_id", "embedding"]), "queries")
    blocks = max(1, -(-rows.count() // block))
    x = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("b"), "dims", F.lit(False).alias("asked"), "vec_id", "embedding")
    q = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), "dims", F.lit(True).alias("asked"), "vec_id", "embedding")
    found = x.unionByName(q).repartition("b", "dims").sortWithinPartitions("b", "dims", "asked").mapInArrow(_searched(k, share), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
