"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document gets a MinHash signature of its 5-word shingles. Documents with equal shingle
sets are one class from the start; only class representatives are joined. Each representative is
posted under its (coordinate, value) tokens. Tokens are ordered by rising frequency, and only
the rarest ``TOKENS - least + 1`` of a document are posted (prefix filter: two documents with
at least ``least`` equal tokens meet in one of those); tokens that no other document has count but
are not written. Lists are merged as pairs of bounded blocks of documents: equal coordinates are
counted there, pairs below the match threshold are skipped, and what is left is confirmed on the
full shingle sets, where pairs that are already connected are skipped. Each block pair returns a
spanning forest of its links, so the output stays linear in the documents of the block pair.
Blocks meet in two rounds: first each with itself and with the first block of its home, then only
those that hold documents of one list in different components of the first round's links. So a
cluster of near copies that the first round connects costs work in proportion to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washkit.llm.common import few, grams, groups_of, mix, stored, utf8, word_codes
from washkit.llm.components import components

#: Signature coordinates; the first TOKENS are posted.
COORDINATES, TOKENS = 128, 64
#: Greatest probabilities that a pair at the threshold agrees in fewer posted, or in fewer of all coordinates, than must agree.
MISSED, ALL_MISSED = 2e-7, 1.1e-6
#: Documents of a block of a posting list.
BLOCK = 256
WORDS = 5

_RNG = np.random.default_rng(77)
_A = (_RNG.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:, None]
_SPACES = bytes(32 if i == 32 or 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))

SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>"


def must_agree(percent: int) -> tuple[int, int]:
    """How many of the posted and of all coordinates must agree: the greatest numbers that a pair
    at ``percent`` / 100 misses with at most MISSED and ALL_MISSED (binomial tails; 38 and 88 at 85)."""
    p, out = percent / 100, []
    for n, missed in ((TOKENS, MISSED), (COORDINATES, ALL_MISSED)):
        k, tail = 0, (1 - p) ** n
        while k < n and tail <= missed:
            k += 1
            tail += comb(n, k) * p**k * (1 - p) ** (n - k)
        out.append(max(k, 1))
    return out[0], out[1]


def shingles(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct codes of each text's word shingles: words parted by ASCII white space,
    A-Z lower-cased; fewer words than a shingle make one shingle, no words none."""
    for codes in word_codes([t.translate(_SPACES) for t in texts]):
        found = grams(codes, min(words, len(codes))) if len(codes) else codes
        found.sort()
        yield found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's permutation over a non-empty shingle set."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    best = None
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 2048):
            m = (_A * h[at : at + 2048] + _B).min(axis=1)
            best = m if best is None else np.minimum(best, m)
    return best


def _signed(batches):
    import pyarrow as pa

    for b in batches:
        ids, n, k1, k2, sigs = b.column(0), [], [], [], []
        for s in shingles(b.column(1).to_pylist()):
            n.append(len(s))
            with np.errstate(over="ignore"):
                k1.append(int(s.sum().astype(np.int64)) if len(s) else 0)
                k2.append(int(mix(s ^ np.uint64(0x5BD1E995)).sum().astype(np.int64)) if len(s) else 0)
            sigs.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))],
            names=["doc_id", "n_shingles", "k1", "k2", "sig"])


def _sets(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([s.tobytes() for s in shingles(b.column(1).to_pylist())], pa.binary())], names=["doc_id", "found"])


def _meet(share: float, least: int):
    """Block pairs (task, side, doc_id, component, n_shingles, sig sorted by task) -> the pairs of
    different components that agree in at least ``least`` coordinates, as one row for each task."""

    def run(batches):
        import pyarrow as pa

        for t in groups_of(batches, "task"):
            task, ids = t.column("task").to_numpy(), t.column("doc_id").to_numpy()
            side, n, of = t.column("side").to_numpy(), t.column("n_shingles").to_numpy(), t.column("component").to_numpy()
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            cut = np.flatnonzero(np.diff(task)) + 1
            tasks, left, right = [], [], []
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(task)], strict=True):
                a, b = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                if not len(b):  # a block against itself
                    b = a
                x, y = [], []
                for i in a:
                    j = b[b > i] if b is a else b
                    near = (of[j] != of[i]) & (n[j] >= share * n[i]) & (share * n[j] <= n[i])
                    j = j[near]
                    j = j[(sig[j] == sig[i]).sum(axis=1) >= least]
                    x.append(np.full(len(j), ids[i]))
                    y.append(ids[j])
                x, y = np.concatenate(x) if x else [], np.concatenate(y) if y else []
                if len(x):
                    tasks.append(task[s])
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.int64()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                                             names=["task", "a", "b"])

    return run


def _root(up: dict, x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _confirm(percent: int):
    """Rows of a task (its pairs, or a document's set) -> links that hold on the full sets,
    fewer than the task has documents."""

    def run(batches):
        import pyarrow as pa

        for t in groups_of(batches, "task", 4000):
            task, found = t.column("task").to_pylist(), t.column("found").combine_chunks()
            ids, a, b = t.column("doc_id"), t.column("a"), t.column("b")
            first = [i for i in range(len(task)) if not i or task[i] != task[i - 1]] + [len(task)]
            u, v = [], []
            for s, e in zip(first, first[1:], strict=False):
                sets, pairs = {}, []
                for i in range(s, e):
                    if found[i].is_valid:
                        sets[ids[i].as_py()] = np.frombuffer(found[i].as_buffer(), np.uint64)
                    else:
                        pairs += zip(a[i].as_py(), b[i].as_py(), strict=True)
                up = {k: k for k in sets}
                for x, y in pairs:
                    if x not in up or y not in up or (rx := _root(up, x)) == (ry := _root(up, y)):
                        continue
                    p, q = sets[x], sets[y]
                    both = np.concatenate([p, q])
                    both.sort()
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * same >= percent * (len(p) + len(q) - same):
                        up[max(rx, ry)] = min(rx, ry)
                        u.append(x)
                        v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def lists_and_blocks(reps: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(listed, blocks) of representatives: the (token, doc_id) of all posting lists with two or more
    documents, in one of which documents with ``least`` equal tokens meet, and the (doc_id, home, blk) of these."""
    tokens = reps.select("doc_id", F.posexplode(F.slice("sig", 1, TOKENS)).alias("c", "v")).select(
        "doc_id", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v").cast("long") + F.lit(1 << 31)).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("doc_id")
    posts = (
        tokens.join(often, "token")
        .withColumn("m", F.count("*").over(own))
        .where(F.col("m") >= least)
        .withColumn("r", F.row_number().over(own.orderBy("f", "token")))
        .where(F.col("r") <= F.col("m") - least + 1)
        .select("doc_id", "token")
    )
    posts = stored(posts, "postings")
    lists = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    listed = posts.join(lists, "token")
    home = listed.groupBy("doc_id").agg(F.max(F.struct("n", "token")).alias("h")).select("doc_id", F.col("h.token").alias("home"))
    homes = home.groupBy("home").agg(F.count("*").alias("n"))
    # documents move to the largest home that a document of one of their lists has, so few blocks are small
    best = listed.select("doc_id", "token").join(home.join(homes, "home"), "doc_id").groupBy("token").agg(F.max(F.struct("n", "home")).alias("h"))
    home = stored(listed.select("doc_id", "token").join(best, "token").groupBy("doc_id").agg(F.max("h").alias("h")).select("doc_id", F.col("h.home").alias("home")), "homes")
    homes = home.groupBy("home").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    blocks = stored(home.join(homes, "home").select("doc_id", "home", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).alias("blk")), "blocks")
    return listed.select("token", "doc_id"), blocks


def first_pairs(blocks: DataFrame) -> DataFrame:
    """(x, y), x <= y: every block with itself and with the first block of its home."""
    own = blocks.select("home", "blk").distinct()
    first = own.groupBy("home").agg(F.min("blk").alias("x"))
    return own.join(first, "home").select(F.explode(F.array("x", "blk")).alias("x"), F.col("blk").alias("y")).distinct()


def later_pairs(listed: DataFrame, blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(x, y), x < y: the block pairs still to be met, that is those with documents of one list in
    different components (``known``: node, component; other documents are their own).

    A list's blocks go by groups: all that hold documents of one component only are one group, a block
    with several is a group by itself. Only different groups are paired, never the blocks of a group."""
    there = (
        listed.join(blocks, "doc_id").join(known, F.col("doc_id") == F.col("node"), "left")
        .groupBy("token", "blk").agg(F.min(F.coalesce("component", "doc_id")).alias("lo"), F.max(F.coalesce("component", "doc_id")).alias("hi"))
        .select("token", "blk", F.struct((F.col("lo") < F.col("hi")).alias("mixed"), F.when(F.col("lo") < F.col("hi"), F.col("blk")).otherwise(F.col("lo")).alias("of")).alias("g"))
    )
    parted = there.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a < b").select("token")
    there = stored(there.join(parted, "token"), "groups")
    groups = there.select("token", "g").distinct()
    pairs = groups.select("token", F.col("g").alias("gx")).join(groups.select("token", F.col("g").alias("gy")), "token").where("gx < gy")
    met = (
        pairs.join(there.select("token", F.col("g").alias("gx"), F.col("blk").alias("bx")), ["token", "gx"])
        .join(there.select("token", F.col("g").alias("gy"), F.col("blk").alias("by")), ["token", "gy"])
        .select(F.least("bx", "by").alias("x"), F.greatest("bx", "by").alias("y")).distinct()
    )
    return met.join(first_pairs(blocks), ["x", "y"], "left_anti")


def _links(docs: DataFrame, members: DataFrame, pairs: DataFrame, percent: int, of_all: int) -> DataFrame:
    """Links (u, v) between documents of different components in the block pairs (x, y)."""
    sides = pairs.select(F.xxhash64("x", "y").alias("task"), F.posexplode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("side", "blk"))
    met = (
        sides.join(members, "blk").select("task", "side", "doc_id", "component", "n_shingles", "sig")
        .repartition("task").sortWithinPartitions("task")
        .mapInArrow(_meet(percent / 100, of_all), "task long, a array<bigint>, b array<bigint>")
    )
    met = stored(met, "met")
    needed = met.select("task", F.explode(F.array_distinct(F.concat("a", "b"))).alias("doc_id"))
    ids = stored(needed.select("doc_id").distinct(), "needed")
    texts = docs.join(F.broadcast(ids) if few(ids) else ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, found binary")
    none = F.lit(None)
    rows = needed.join(sets, "doc_id").select("task", "doc_id", "found", none.cast("array<bigint>").alias("a"), none.cast("array<bigint>").alias("b")) \
        .unionByName(met.select("task", none.cast("long").alias("doc_id"), none.cast("binary").alias("found"), "a", "b"))
    found = rows.repartition("task").sortWithinPartitions("task").mapInArrow(_confirm(percent), "u long, v long")
    return stored(found, "links")


def links(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between class representatives that connect all documents whose Jaccard
    similarity is at least ``percent`` / 100. ``docs``: (doc_id, text bytes)."""
    least, of_all = must_agree(percent)
    listed, blocks = lists_and_blocks(reps, least)
    members = blocks.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id")
    known = stored(components(_links(docs, members.withColumn("component", F.col("doc_id")), first_pairs(blocks), percent, of_all)), "known")
    joined = members.join(known, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id"))
    later = _links(docs, joined, later_pairs(listed, blocks, known), percent, of_all)
    return known.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(later)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their distinct 5-word
    shingles (``percent`` from 80 up; how many coordinates must agree follows it). component_id is the
    least id reachable over links, kept marks the row that has it. A null, empty or wordless text
    has an empty set and is linked with nothing. Rows with a null id keep a null component_id and
    are kept. Rows that repeat an id and a text share their result. Other columns are not read.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    sigs = stored(base.mapInArrow(_signed, SIGNATURES), "signatures")
    full = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    joined = components(links(base, reps, percent))
    labels = classes.join(joined, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.join(labels, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.when(F.col("doc_id").isNull(), True).otherwise(F.col("doc_id") == component).alias("kept"))
