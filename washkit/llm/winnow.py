"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least 5-gram codes of its sliding windows; two texts that share
a window of 10 words share that window's fingerprint, so joining the fingerprints of documents and
benchmark items finds every shared window. Each hit is then extended word by word to both sides,
compared by the words' bytes, and only runs of a whole window count. Items with fewer words than a
window are one window of their own length and are looked up by the code of all their words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import coded_runs, grams, stored, utf8, word_codes

WINDOW, GRAM = 10, 5
#: Benchmarks of up to so many bytes of text are sent to every task; larger ones are joined.
BROADCAST_BYTES = 16 << 20

#: A-Z lower-cased, 0-9, a-z and bytes from 0x80 are word bytes, all others part words.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

HITS = "spans array<struct<first:bigint,last:bigint>>, items array<string>"


def fingerprints(codes: np.ndarray, window: int = WINDOW, k: int = GRAM) -> np.ndarray:
    """The least k-gram code of every window of ``window`` words."""
    g = grams(codes, k)
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = g[:n]
    for t in range(1, window - k + 1):
        low = np.minimum(low, g[t : t + n])
    return low


class Index:
    """Fingerprints of benchmark items and what is needed to extend a hit."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = GRAM):
        self.window, self.k = window, k
        self.posted: dict[int, list[tuple[int, int]]] = {}  # fingerprint -> (item, word)
        self.short: dict[int, dict[int, list[tuple[str, list[bytes]]]]] = {}  # words -> code -> items
        self.items: list[tuple[str, np.ndarray, bytes]] = []
        self.split = lru_cache(64)(lambda item: self.items[item][2].translate(_WORDS).split())
        for (name, text), codes in zip(items, word_codes([t.translate(_WORDS) for _, t in items]), strict=True):
            n = len(codes)
            if not n:
                continue
            if n < window:
                self.short.setdefault(n, {}).setdefault(int(grams(codes, n)[0]), []).append((name, text.translate(_WORDS).split()))
                continue
            low, g = set(fingerprints(codes, window, k).tolist()), grams(codes, k).tolist()
            for at, x in enumerate(g):
                if x in low:
                    self.posted.setdefault(x, []).append((len(self.items), at))
            self.items.append((name, codes, text))
        self.prints = np.sort(np.fromiter(self.posted, np.uint64, len(self.posted)))
        self.maybe = np.zeros(1 << 20, np.bool_)
        self.maybe[self.prints & np.uint64(len(self.maybe) - 1)] = True
        self.shorts = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.short.items()}

    def known(self, low: np.ndarray) -> np.ndarray:
        """Positions of the codes that are fingerprints of an item."""
        at = np.flatnonzero(self.maybe[low & np.uint64(len(self.maybe) - 1)])
        if not len(at):
            return at
        return at[np.isin(low[at], self.prints)]

    def hits(self, codes: np.ndarray, text: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [first, last) of hit words of one document, and the items that hit it."""
        runs, names, n, own = [], set(), len(codes), None
        if n >= self.window and len(self.prints):
            wanted = set(fingerprints(codes, self.window, self.k)[self.known(fingerprints(codes, self.window, self.k))].tolist())
            g = grams(codes, self.k)
            done: dict[tuple[int, int], int] = {}  # (item, shift) -> end of the last run there
            for at in self.known(g).tolist():
                if int(g[at]) not in wanted:
                    continue
                for item, y in self.posted[int(g[at])]:
                    if done.get((item, at - y), -1) >= at + self.k:
                        continue
                    name, words, _ = self.items[item]
                    left = min(at, y)
                    same = codes[at - left : at][::-1] == words[y - left : y][::-1]
                    left = left if same.all() else int(same.argmin())
                    right = min(n - at, len(words) - y)
                    same = codes[at : at + right] == words[y : y + right]
                    right = right if same.all() else int(same.argmin())
                    done[item, at - y] = at + right
                    if left + right >= self.window:
                        own = own or text.translate(_WORDS).split()
                        real = equal_runs(own[at - left : at + right], self.split(item)[y - left : y + right], self.window)
                        runs += [(at - left + a, at - left + b) for a, b in real]
                        names.update([name] if real else ())
        for k, known in self.shorts.items():
            g = grams(codes, k)
            for at in np.flatnonzero(np.isin(g, known)).tolist():
                own = own or text.translate(_WORDS).split()
                real = [name for name, words in self.short[k][int(g[at])] if words == own[at : at + k]]
                runs += [(at, at + k)] if real else []
                names.update(real)
        return merged(runs), names

    def candidates(self, codes: np.ndarray, offsets: np.ndarray) -> set[int]:
        """Documents of a run that may hold a hit (windows over two documents only add some)."""
        at = [self.known(fingerprints(codes, self.window, self.k))] if len(self.prints) else []
        at += [np.flatnonzero(np.isin(grams(codes, k), known)) for k, known in self.shorts.items()]
        return set((np.searchsorted(offsets, np.concatenate(at), side="right") - 1).tolist()) if at else set()


def equal_runs(a: list[bytes], b: list[bytes], least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` places where two lists of one length agree."""
    if a == b:
        return [(0, len(a))] if len(a) >= least else []
    edge = [-1, *(i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a)]
    return [(x + 1, y) for x, y in zip(edge, edge[1:], strict=False) if y - x - 1 >= least]


def ordered(names) -> list[str | None]:
    """Distinct item ids in order, the null one last."""
    return sorted(names, key=lambda x: (x is None, x or ""))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sent(shipped):
    """Documents against the whole benchmark."""

    def run(batches):
        import pyarrow as pa

        index = Index(shipped.value)
        for b in batches:
            n, spans, items = [], [], []
            texts = b.column("text").to_pylist()
            for first, codes, offsets in coded_runs([t.translate(_WORDS) for t in texts]):
                found = index.candidates(codes, offsets)
                for i in range(len(offsets) - 1):
                    runs, names = index.hits(codes[offsets[i] : offsets[i + 1]], texts[first + i]) if i in found else ((), ())
                    n.append(int(offsets[i + 1] - offsets[i]))
                    spans.append([{"first": x, "last": y} for x, y in runs])
                    items.append(ordered(names))
            own = [c for c in b.schema.names if c == "key"]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(items, pa.list_(pa.string())),
                 *(b.column(c) for c in own)],
                names=["doc_id", "n_words", "spans", "items", *own])

    return run


def _printed(batches):
    """(key, n_words, prints): fingerprints of long texts, or -for texts below a window- one code with its length."""
    import pyarrow as pa

    for b in batches:
        n, prints = [], []
        for codes in word_codes([t.translate(_WORDS) for t in b.column("text").to_pylist()]):
            n.append(len(codes))
            prints.append(np.unique(fingerprints(codes) if len(codes) >= WINDOW else grams(codes, len(codes)) if len(codes) else codes).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=["key", "n_words", "prints"])


def _short_codes(lengths: list[int]):
    """(key, prints): codes of all k-word sequences, for the lengths that short items have."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            prints = [np.unique(np.concatenate([grams(c, k) for k in lengths])).view(np.int64) for c in word_codes([t.translate(_WORDS) for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(prints, pa.list_(pa.int64()))], names=["key", "prints"])

    return run


def _extended(batches):
    """(key, item_id, text, item) -> (key, item_id, spans) of the pairs that share a window."""
    import pyarrow as pa

    for b in batches:
        keys, names, spans = [], [], []
        for key, name, text, item in zip(*(b.column(c).to_pylist() for c in ("key", "item_id", "text", "item")), strict=True):
            runs, found = Index([(name, item)]).hits(next(word_codes([text.translate(_WORDS)])), text)
            if found:
                keys.append(key)
                names.append(name)
                spans.append([{"first": x, "last": y} for x, y in runs])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                                         names=["key", "item_id", "spans"])


def _merged_spans(batches):
    import pyarrow as pa

    for b in batches:
        spans = [[{"first": x, "last": y} for x, y in merged([(r["first"], r["last"]) for r in rows or ()])] for rows in b.column("spans").to_pylist()]
        own = [c for c in b.schema.names if c == "key"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                                          pa.array([ordered(x or ()) for x in b.column("items").to_pylist()], pa.list_(pa.string())), *(b.column(c) for c in own)],
                                         names=["doc_id", "n_words", "spans", "items", *own])


def _joined(base: DataFrame, items: DataFrame) -> DataFrame:
    """The same result by joins alone, for benchmarks of any size."""
    own = [F.col("own").alias("key")] if "key" in base.columns else []
    base = stored(base.withColumnRenamed("key", "own").withColumn("key", F.xxhash64("doc_id", "text")), "documents")
    printed = stored(base.select("key", "text").mapInArrow(_printed, "key long, n_words long, prints array<bigint>"), "prints")
    codes = stored(items.select(F.monotonically_increasing_id().alias("key"), "item_id", "text"), "items")
    of_items = stored(codes.mapInArrow(_printed, "key long, n_words long, prints array<bigint>"), "item-prints")
    lengths = [r[0] for r in of_items.where(f"n_words BETWEEN 1 AND {WINDOW - 1}").select("n_words").distinct().collect()]
    left = printed.where(f"n_words >= {WINDOW}").select("key", F.explode("prints").alias("p"))
    if lengths:
        left = left.union(base.select("key", "text").mapInArrow(_short_codes(lengths), "key long, prints array<bigint>").select("key", F.explode("prints").alias("p")))
    right = of_items.select(F.col("key").alias("item_key"), F.explode("prints").alias("p"))
    pairs = left.join(right, "p").select("key", "item_key").distinct()
    both = pairs.join(codes.select(F.col("key").alias("item_key"), "item_id", F.col("text").alias("item")), "item_key") \
        .join(base.select("key", "text").distinct(), "key")
    found = both.select("key", "item_id", "text", "item").mapInArrow(_extended, "key long, item_id string, spans array<struct<first:bigint,last:bigint>>")
    found = stored(found, "hits").groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.collect_set("item_id").alias("items"), F.bool_or(F.col("item_id").isNull()).alias("nameless")) \
        .withColumn("items", F.when(F.col("nameless"), F.array_append("items", F.lit(None).cast("string"))).otherwise(F.col("items")))
    counts = printed.groupBy("key").agg(F.max("n_words").alias("n_words"))
    return base.drop("text").join(counts, "key").join(found, "key", "left").select("doc_id", "n_words", "spans", "items", *own) \
        .mapInArrow(_merged_spans, f"doc_id long, n_words long, {HITS}" + ", key binary" * len(own))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, key_col: str | None = None, null_items: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document, with the binary ``key_col`` as key where given.

    spans: maximal runs [first, last) of words inside an occurrence of a window of an item; items:
    the ids of those items as sorted strings. Words are runs of a-z, 0-9 and non-ASCII characters
    after A-Z is lower-cased. A null or wordless text has no words and no hits; null or wordless
    items hit nothing, nor do items without an id, unless ``null_items``: then their windows count like
any other and items ends with one null for all of them. Repeated rows count as they stand. Whether the
    benchmark is sent to the tasks or joined depends on its measured size alone; the result does not.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), *([F.col(key_col).alias("key")] if key_col else []))
    given = items.select(F.col(item_col).cast("string").alias("item_id"), utf8(item_text).alias("text")).distinct()
    given = given if null_items else given.where("item_id IS NOT NULL")
    size = given.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(base, given)
    rows = [(r[0], bytes(r[1])) for r in given.collect()]  # at most broadcast_bytes
    return base.mapInArrow(_sent(docs.sparkSession.sparkContext.broadcast(rows)), f"doc_id long, n_words long, {HITS}" + ", key binary" * bool(key_col))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`contamination`'s spans and items. All items without an id count
    as one in n_items and have no part in the digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
