"""Removal of repeated byte strings by blockwise suffix sorting.

1. *Suffix buckets.* Each ``min_bytes`` window of a text is keyed by its least 32-gram code, its
   anchor (the rightmost of equals): equal windows have equal anchors at equal distances. Windows
   with one anchor position are consecutive, so a text is a list of segments (anchor, first start,
   number of starts), and a bucket holds the segments of one anchor value.
2. Equal segments (by anchor, length and a digest of all their bytes) are counted; where one occurs twice, all its windows repeat. A bucket with one
   distinct segment needs no sorting. One copy of each distinct segment of the others is cut out.
3. *Blockwise sorting.* A task sorts one bucket at a time. Positions are numbered from the anchor, so
   only suffixes with equal numbers can share a window, and the difference cover need serve the
   difference 0 only: the cover sample is every ``PERIOD``-th position. The sample's suffixes are
   ranked first; then the suffixes at each position are sorted by their first PERIOD bytes, long
   ties by the rank of the next sample position, and what the rank leaves by the window's last
   bytes. Neighbours that tie in all three repeat. Memory is one bucket's distinct segments.
4. A bucket of more than ``BLOCK`` distinct segments is cut into blocks by segment; each block
   reports one code for each of its different windows, and windows of two blocks meet by code.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import SENT_IDS, Rolling, few, groups_of, stored, utf8

MIN_BYTES, GRAM, PERIOD, BLOCK = 400, 32, 64, 8192

SEGMENT = "starts array<int>, n int, rel int, anchor long, hull long"


def segments(data: bytes, size: int) -> tuple[np.ndarray, ...] | None:
    """(start, n, rel, anchor, hull) arrays of a text's segments: ``n`` window starts from ``start``
    on share the anchor ``rel`` bytes after ``start``; hull is a digest of all bytes they cover."""
    starts_n = len(data) - size + 1
    if starts_n <= 0:
        return None
    codes = Rolling(np.frombuffer(data, np.uint8))
    at = np.arange(len(data) - GRAM + 1)
    g = codes.of(at, at + GRAM)
    w = size - GRAM + 1
    low, span = g, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:starts_n], low[w - span : w - span + starts_n])
    newest = g[w - 1 : w - 1 + starts_n] == low
    fresh = newest.copy()
    fresh[0] = True
    fresh[1:] |= low[1:] != low[:-1]
    start = np.flatnonzero(fresh)
    end = np.r_[start[1:], starts_n]
    rel = np.full(len(start), w - 1)
    lost = np.flatnonzero(~newest[start])  # the window's least gram is somewhere inside
    for s in range(0, len(lost), 256):
        j = start[lost[s : s + 256]]
        inside = g[j[:, None] + np.arange(w - 1, -1, -1)]
        rel[lost[s : s + 256]] = w - 1 - inside.argmin(axis=1)
    hull = [hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), (end - 1 + size).tolist(), strict=True)]
    return start, end - start, rel, low[start], np.frombuffer(b"".join(hull), np.uint64)


def _segments(size: int):
    """One row for each different segment of a text, with all its starts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            k0, k1, times, cols = [], [], [], [[] for _ in range(5)]
            for x, y, t in zip(b.column("k0").to_numpy(), b.column("k1").to_numpy(), b.column("text"), strict=True):
                found = segments(t.as_py(), size)
                if found is None:
                    continue
                start, n, rel, anchor, hull = found
                order = np.lexsort((start, n, hull, anchor))
                a, h, m = anchor[order], hull[order], n[order]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
                k0.append(np.full(len(first), x))
                k1.append(np.full(len(first), y))
                times.append(np.diff(np.r_[first, len(order)]))
                for c, v in zip(cols, (start[order], m[first], rel[order][first], a[first], h[first]), strict=True):
                    c.append(v)
            if k0:
                start, n, rel, anchor, hull = (np.concatenate(c) for c in cols)
                starts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(times))].astype(np.int32)), pa.array(start.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(k0)), pa.array(np.concatenate(k1)), starts, pa.array(n.astype(np.int32)), pa.array(rel.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(hull.view(np.int64))],
                    names=["k0", "k1", "starts", "n", "rel", "anchor", "hull"])

    return run


def _cut(size: int):
    """A text with the segments wanted from it -> one row with the bytes of each."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = {k: [] for k in ("task", "anchor", "hull", "n", "rel", "split", "text")}
            for t, wanted in zip(b.column("text"), b.column("wanted").to_pylist(), strict=True):
                t = t.as_py()
                for s in wanted:
                    for k in ("task", "anchor", "hull", "n", "rel", "split"):
                        out[k].append(s[k])
                    out["text"].append(t[s["start"] : s["start"] + s["n"] - 1 + size])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def sort_bucket(texts: list[bytes], rels: list[int], counts: list[int], size: int, period: int = PERIOD):
    """Window starts of a bucket's segments that repeat in the bucket: for each segment a list of
    offsets, and all (segment, offset) with a flag in sorted order, each different window's first
    occurrence last (used to report a block's windows once)."""
    period = min(period, size // 4)
    length = size - period
    ranks: list[dict[int, int]] = [{} for _ in texts]
    base = -max(rels)
    last = max(n - r for n, r in zip(counts, rels, strict=True))  # one past the largest numbered start
    for q in range(-(-base // period) * period, last + period, period):  # the cover sample
        found = {}
        for s, t in enumerate(texts):
            at = q + rels[s]
            if 0 <= at <= len(t) - length:
                found.setdefault(t[at : at + length], []).append(s)
        for rank, text in enumerate(sorted(found)):
            for s in found[text]:
                ranks[s][q] = rank
    repeated: list[list[int]] = [[] for _ in texts]
    single: list[tuple[int, int]] = []  # windows seen once here
    first: list[tuple[int, int]] = []  # one of each group of equal windows
    for p in range(base, last):
        q = -(-p // period) * period
        suffixes = []
        for s, t in enumerate(texts):
            at = p + rels[s]
            if 0 <= at < counts[s]:
                suffixes.append((t[at : at + period], ranks[s][q], t[at + q - p + length : at + size], s))
        suffixes.sort()
        i = 0
        while i < len(suffixes):
            j = i + 1
            while j < len(suffixes) and suffixes[j][:3] == suffixes[i][:3]:
                j += 1
            if j - i > 1:
                for x in suffixes[i:j]:
                    repeated[x[3]].append(p + rels[x[3]])
                first.append((suffixes[i][3], p + rels[suffixes[i][3]]))
            else:
                single.append((suffixes[i][3], p + rels[suffixes[i][3]]))
            i = j
    return repeated, single, first


def runs_of(offsets: list[int]) -> list[int]:
    """Sorted offsets as [first, one past last, first, ...]."""
    out: list[int] = []
    for x in offsets:
        if out and out[-1] == x:
            out[-1] = x + 1
        else:
            out += [x, x + 1]
    return out


def _sorted_buckets(size: int):
    def run(batches):
        import pyarrow as pa

        for t in groups_of(batches, "task", 4000):
            task, anchor, hull, n = (t.column(c).to_pylist() for c in ("task", "anchor", "hull", "n"))
            rel, split, text = t.column("rel").to_pylist(), t.column("split").to_pylist(), t.column("text")
            cut = [i for i in range(len(task)) if not i or task[i] != task[i - 1]] + [len(task)]
            out = {k: [] for k in ("anchor", "hull", "n", "runs", "offsets", "codes")}
            for s, e in zip(cut, cut[1:], strict=False):
                own = list({(anchor[i], hull[i], n[i]): i for i in range(s, e)}.values())
                texts = [text[i].as_py() for i in own]
                repeated, single, first = sort_bucket(texts, [rel[i] for i in own], [n[i] for i in own], size)
                offsets: list[list[int]] = [[] for _ in own]
                codes: list[list[int]] = [[] for _ in own]
                if split[s]:  # windows that other blocks of this bucket may have too
                    for found, once in ((single, True), (first, False)):
                        for k, at in found:
                            offsets[k].append(at if once else -1)
                            codes[k].append(int.from_bytes(hashlib.blake2b(texts[k][at : at + size], digest_size=8).digest(), "little", signed=True))
                for k, i in enumerate(own):
                    if repeated[k] or offsets[k]:
                        for c, v in zip(out.values(), (anchor[i], hull[i], n[i], runs_of(repeated[k]), offsets[k], codes[k]), strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _spans(whole_chars: bool):
    """Covered intervals of each text, merged; the rest of the text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            size, spans, kept, whole = [], [], [], []
            for t, found in zip(b.column("text"), b.column("found").to_pylist(), strict=True):
                t, out = t.as_py(), []
                for x, y in sorted((f["first"], f["last"]) for f in found or ()):
                    if out and x <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], y)
                    else:
                        out.append([x, y])
                edges = [0, *(x for s in out for x in s), len(t)]
                rest = [t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)] if out else [t]
                chars = [r.decode("utf-8", "ignore").encode() for r in rest] if out else rest
                kept.append(b"".join(chars if whole_chars else rest))
                whole.append(b"".join(chars).decode() if chars != rest else None)
                size.append(len(t))
                spans.append([{"first": x, "last": y} for x, y in out])
            own = [c for c in b.schema.names if c == "key"]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(whole, pa.string()), *(b.column(c) for c in own)],
                names=["doc_id", "n_bytes", "spans", "kept", "whole", *own])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, block: int = BLOCK, key_col: str | None = None,
                   whole_chars: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, whole) of every row of ``docs``, with the binary ``key_col`` as key where given.

    spans: maximal runs [first, last) of bytes covered by a ``min_bytes`` string (128 or more) that
    also starts anywhere else in the table, in the same text included; kept: the remaining bytes.
    All occurrences count, the first included. Strings never cross texts. A null text is empty; a
    text shorter than ``min_bytes`` is kept whole. whole: kept without the rest of characters that a
    span's edge broke, null where none is broken; with ``whole_chars`` kept is that too. A repeated row repeats its text, so all copies
    lose it. Rows with a null id take part like any other. Other columns are not read.
    """
    if min_bytes < 128:
        raise ValueError("min_bytes must be 128 or more")
    own = ["key"] if key_col else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), *([F.col(key_col).alias("key")] if key_col else [])) \
        .select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k1"), "doc_id", "text", *own)
    segs = stored(base.select("k0", "k1", "text").mapInArrow(_segments(min_bytes), f"k0 long, k1 long, {SEGMENT}"), "segments")
    hulls = stored(segs.groupBy("anchor", "hull", "n").agg(F.sum(F.size("starts")).alias("c"), F.min(F.struct("k0", "k1", F.get("starts", F.lit(0)).alias("start"), "rel")).alias("at")), "hulls")
    buckets = hulls.groupBy("anchor").agg(F.count("*").alias("h"), F.min("c").alias("least")).where("h > 1 AND least = 1").drop("least")
    parts = F.ceil(F.col("h") / F.lit(block))
    wanted = (
        hulls.join(buckets, "anchor")
        .select("at.k0", "at.k1", F.struct(F.xxhash64("anchor", F.pmod(F.xxhash64("hull"), parts)).alias("task"), "anchor", "hull", "n", "at.start", "at.rel", (parts > 1).alias("split")).alias("s"))
        .groupBy("k0", "k1").agg(F.collect_list("s").alias("wanted"))
    )
    wanted = stored(wanted, "wanted")
    ids = wanted.select("k0", "k1")
    holders = base.select("k0", "k1", "text")
    if few(ids, SENT_IDS // 2):
        holders = holders.join(F.broadcast(ids), ["k0", "k1"], "left_semi")
    cut = holders.join(wanted, ["k0", "k1"]).select("text", "wanted") \
        .mapInArrow(_cut(min_bytes), "task long, anchor long, hull long, n int, rel int, split boolean, text binary")
    found = stored(cut.repartition("task").sortWithinPartitions("task").mapInArrow(
        _sorted_buckets(min_bytes), "anchor long, hull long, n int, runs array<int>, offsets array<int>, codes array<bigint>"), "sorted")
    met = found.where(F.size("codes") > 0).select("anchor", "hull", "n", F.explode(F.arrays_zip("offsets", "codes")).alias("x")).select("anchor", "hull", "n", "x.offsets", "x.codes")
    shared = met.groupBy("anchor", "codes").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "codes")
    across = met.where("offsets >= 0").join(shared, ["anchor", "codes"]).select("anchor", "hull", "n", F.array("offsets", F.col("offsets") + 1).alias("runs"))
    once = found.where(F.size("runs") > 0).select("anchor", "hull", "n", "runs").unionByName(across)
    twice = hulls.where("c > 1").select("anchor", "hull", "n", F.array(F.lit(0), F.col("n")).alias("runs"))
    runs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct(F.get("runs", i * 2).alias("a"), F.get("runs", i * 2 + 1).alias("b")))
    spans = F.flatten(F.transform("starts", lambda s: F.transform(runs, lambda r: F.struct((s + r["a"]).cast("long").alias("first"), (s + r["b"] - 1 + min_bytes).cast("long").alias("last")))))
    covered = (
        segs.select("k0", "k1", "starts", "n", "anchor", "hull").join(once.unionByName(twice), ["anchor", "hull", "n"])
        .select("k0", "k1", spans.alias("f"))
        .groupBy("k0", "k1").agg(F.flatten(F.collect_list("f")).alias("found"))
    )
    covered = stored(covered, "covered")
    ids = covered.select("k0", "k1")
    if few(ids, SENT_IDS // 2):  # only the texts that lose bytes are shuffled
        whole = base.join(F.broadcast(ids), ["k0", "k1"], "left_anti").select("doc_id", "text", F.lit(None).cast(covered.schema["found"].dataType).alias("found"), *own)
        joined = base.join(F.broadcast(ids), ["k0", "k1"], "left_semi").join(covered, ["k0", "k1"]).select("doc_id", "text", "found", *own).unionByName(whole)
    else:
        joined = base.join(covered, ["k0", "k1"], "left").select("doc_id", "text", "found", *own)
    return joined.mapInArrow(_spans(whole_chars), "doc_id long, n_bytes long, spans array<struct<first:bigint,last:bigint>>, kept binary, whole string" + ", key binary" * len(own))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`repeated_spans`'s rows, and ``text``: what is left of each text,
    without the rest of characters that a span's edge broke."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("whole", F.col("kept").cast("string")).alias("text"))
