"""Blocks of near copies meet in two rounds: no link is lost, and a connected cluster costs block
pairs in proportion to its blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from washkit.llm import minhash
from washkit.llm.common import utf8
from washkit.llm.components import components


def copies(seed, n, first, changed=3, step=0):
    """n variants of one text of 300 words; with a step, each differs from the one before it only by that many words."""
    rng = np.random.default_rng(seed)
    base = [f"t{seed}x{i}" for i in range(300)]
    out = []
    for i in range(n):
        if step:
            base = [*base[step:], *(f"t{seed}y{i}z{k}" for k in range(step))]
            words = base
        else:
            words = list(base)
            for at in rng.choice(300, changed, replace=False):
                words[at] = f"v{i}"
        out.append((first + i, " ".join(words)))
    return out


def brute(rows, percent):
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("size", [2, 8])
def test_every_link_in_small_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(minhash, "BLOCK", size)
    rows = copies(1, 60, 0) + copies(2, 30, 100, changed=8) + copies(3, 40, 200, step=10) + copies(4, 5, 300)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    want = brute(rows, 80)
    assert got == want and len(set(want.values())) < 40
    assert {want[200 + i] for i in range(40)} == {200}  # a chain: only neighbours are near


def _rounds(spark, rows, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", utf8("text").alias("text"))
    reps = docs.mapInArrow(minhash._signed, minhash.SIGNATURES)
    least, of_all = minhash.must_agree(percent)
    listed, blocks = minhash.lists_and_blocks(reps, least)
    first = minhash.first_pairs(blocks)
    members = blocks.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id").withColumn("component", F.col("doc_id"))
    known = components(minhash._links(docs, members, first, percent, of_all))
    return listed, blocks, first, known


def test_a_connected_cluster_meets_in_proportion_to_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    listed, blocks, first, known = _rounds(spark, copies(5, 80, 0, changed=2), 80)
    n = blocks.select("blk").distinct().count()
    assert n >= 10
    assert first.count() <= 2 * n
    assert {r.component for r in known.collect()} == {0}
    assert minhash.later_pairs(listed, blocks, known).count() == 0


def test_blocks_of_several_components_meet_once(spark):
    blocks = spark.createDataFrame([(i, 7, i // 2) for i in range(12)], "doc_id long, home long, blk long")
    listed = spark.createDataFrame([(1, i) for i in range(12)] + [(2, i) for i in range(4)], "token long, doc_id long")
    known = spark.createDataFrame([(i, 0) for i in range(11)], "node long, component long")  # document 11 is on its own: block 5 is mixed
    got = sorted(tuple(r) for r in minhash.later_pairs(listed, blocks, known).collect())
    assert got == [(1, 5), (2, 5), (3, 5), (4, 5)]  # block 0 is the home's first: it met block 5 before
    assert sorted(tuple(r) for r in minhash.first_pairs(blocks).collect()) == [(0, 0), *((0, i) for i in range(1, 6)), *((i, i) for i in range(1, 6))]
