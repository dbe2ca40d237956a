"""Spelling variants: words one edit apart, found with an index of variable-length grams.

1. *Dictionary.* Grams of ``QMIN`` characters that are frequent over all words are extended by a
   character, frequent ones of those again, up to ``QMAX``. A word's gram at a place is the longest
   the dictionary has there: short where grams are rare, long where they are common.
2. *Affected grams.* An edit at place i can change the gram that starts at p <= i only where the
   walk down the dictionary from p comes as far as i; it changes none that starts behind i. So for
   each place there is a bound on the grams that an edit affects, and words one edit apart share
   all others: those on the left that end before the walk's reach, and those on the right.
3. *Lists.* A word is posted once for each edit (a character replaced or deleted, or a gap filled)
   under the grams that this edit leaves. Merging all lists of these grams with the number of them
   as the bound is a lookup of one key, so lists are merged by one shuffle and no pair is formed.
4. *Verification.* A list holds words that differ in the affected stretch only. It is read in the
   order of what is left of a word without the edited character; words next to each other that
   agree on it are one edit apart, at most as many as there are letters. Each adds a count and its
   best neighbour, so the rows grow with the words, whatever their lists hold.

A word of n characters gives 2 n + 1 postings. Up to ``LONG`` characters they hold what is left of
the word as text; beyond, as hashes, so a very long word costs in proportion to its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import stored

#: Gram lengths, and the most grams of one length that are extended: a gram is frequent with at
#: least a DICTIONARY-th of all places of QMIN-grams, so the dictionary's bound holds for any corpus.
QMIN, QMAX, DICTIONARY = 2, 5, 4096
#: Code points of a word without the edited one up to which postings hold it as text; longer ones are
#: held as hashes modulo a Mersenne prime, with two bases.
LONG, PRIME, BASES = 64, 2**61 - 1, (0x1D8AF53B2F96C4E7, 0x0B5297A4D1E3C86D)
#: Grams a task counts before it passes them on.
HELD = 1 << 20

# Fixed value: the letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def damaged_runs(docs: DataFrame, least: int = 7) -> DataFrame:
    """(word): the runs of letters of all texts, A-Z lowered; a run whose crc32 of ``doc_id:run`` 31
    divides lacks the character at that number modulo its length. A null id counts as empty. Runs
    of fewer than ``least`` characters never make a word and are left out early."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least).select("doc_id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.encode(F.concat("doc_id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.pmod("h", F.lit(31)) == 0, short).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def word_counts(words: DataFrame, at_least: int = 2) -> DataFrame:
    """(word, n) of the words that occur ``at_least`` times."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _grams(low: int, high: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "c"])
            counts.clear()
            return batch

        for b in batches:
            for w in b.column("word").to_pylist():
                for q in range(low, high + 1):
                    counts.update([w[p : p + q] for p in range(len(w) - q + 1)])
            if len(counts) > HELD:
                yield out()
        yield out()

    return run


def gram_dictionary(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, size: int = DICTIONARY) -> frozenset[str]:
    """The grams of ``qmin`` to ``qmax - 1`` characters that the dictionary extends, counted over
    all ``words``: at most ``size`` of each length, as only that many can reach the frequency."""
    counts = stored(words.select("word").mapInArrow(_grams(qmin, qmax - 1), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c")), "grams")
    places = counts.where(F.char_length("gram") == qmin).agg(F.sum("c")).first()[0] or 0
    return frozenset(r["gram"] for r in counts.where(F.col("c") * size >= places).select("gram").collect())


def left_ends(word: str, extended: frozenset[str], qmin: int = QMIN, qmax: int = QMAX) -> list[int]:
    """For each place 0 to ``len(word)``: the end of the last gram on its left that an edit there leaves."""
    n = len(word)
    ends = bytearray(n + 2)
    for p in range(n):
        reach = p + qmin - 1  # an edit up to here changes the gram at p
        while reach < p + qmax - 1 and reach < n and word[p : reach + 1] in extended:
            reach += 1
        if reach < n:
            ends[reach + 1] = 1
    out, last = [], 0
    for i in range(n + 1):
        last = i if ends[i] else last
        out.append(last)
    return out


def _ends(extended, qmin: int, qmax: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ends = [left_ends(w, extended.value, qmin, qmax) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ends, pa.list_(pa.int32()))], names=["word", "n", "ends"])

    return run


def _hashes(codes: list[int]) -> list[tuple[int, int]]:
    """Polynomial hashes of all prefixes, modulo a prime and with two bases."""
    x = y = 0
    out = [(0, 0)]
    for c in codes:
        x, y = (x * BASES[0] + c + 1) % PRIME, (y * BASES[1] + c + 1) % PRIME
        out.append((x, y))
    return out


def _long_postings(extended, qmin: int, qmax: int):
    """Postings of words with rests longer than LONG: prefixes and suffixes go by their hashes, so
    a word gives rows in proportion to its length, each of a fixed size."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = {"left": pa.string(), "right": pa.string(), "at": pa.int32(), "rest": pa.string(), "letter": pa.string(), "next": pa.string(), "key": pa.string(), "n": pa.int64()}
        rows: list[tuple] = []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds.values(), strict=True)], names=list(kinds))
            rows.clear()
            return batch

        for b in batches:
            for word, key, n in zip(*(b.column(c).to_pylist() for c in ("word", "key", "n")), strict=True):
                codes, size = [ord(c) for c in word], len(word)
                head, tail = _hashes(codes), _hashes(codes[::-1])[::-1]
                ends = left_ends(word, extended.value, qmin, qmax)
                for at in range(size + 1):
                    for letter, skip in ((None, 0), (word[at : at + 1], 1)):
                        if size - skip > LONG and at + skip <= size:
                            right = "%x.%x" % tail[at + skip]
                            rows.append(("%x.%x" % head[ends[at]], right, at, f"\0{size - skip}.%x.%x." % head[at] + right, letter, word[at + skip : at + skip + 1], key, n))
                    if len(rows) > 20000:
                        yield out()
        yield out()

    return run


def _same(x) -> np.ndarray:
    """Whether each row but the first of an Arrow column equals the one before."""
    import pyarrow.compute as pc

    return pc.equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)


def _near(batches) -> Iterator:
    """Rows (list, at, rest, letter, next, key, n) in order -> for each word that shares a rest with
    another: (word, its near words here, the best one's n and word). A null letter is the word
    ``rest`` itself; ``next`` and ``key`` hold a long rest's letter behind the place and its word's key."""
    import pyarrow as pa

    names = ("list", "at", "rest")
    held: list = []

    def found(t):
        same = np.ones(len(t) - 1, np.bool_)
        for c in names:
            same &= _same(t.column(c).combine_chunks())
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        out: list[tuple] = []
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            part = t.slice(s, e - s + 1).to_pydict()
            rest, at = part["rest"][0], part["at"][0]
            # A letter filled in before an equal one is counted behind it; words of one rest are in the order of their letters here.
            follows = rest[at : at + 1] if part["key"][0] is None else part["next"][part["letter"].index(None)] if None in part["letter"] else ""
            words = sorted((-n, follows if c is None else c, c is None, (rest if c is None else rest[:at] + c + rest[at:]) if key is None else key)
                           for c, key, n in zip(part["letter"], part["key"], part["n"], strict=True))
            own = next((x for x in words if x[2]), None)
            others = [x for x in words if not x[2]]
            beside = [x for x in others if x[1] != follows]
            if own and beside:
                out.append((own[3], len(beside), -beside[0][0], beside[0][3]))
            for k, x in enumerate(others):
                near = others[:1] if k else others[1:2]
                count = len(others) - 1
                if own and x[1] != follows:
                    near, count = [*near, own], count + 1
                if near:
                    top = min(near)
                    out.append((x[3], count, -top[0], top[3]))
        cols = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "near", "best_n", "best_key"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if sum(h.num_rows for h in held) < 50000:
            continue
        t = pa.concat_tables(held).combine_chunks()
        last = t.num_rows - 1  # the rows of the last rest may go on in the next batch
        while last and all(t.column(c)[last - 1].equals(t.column(c)[last]) for c in names):
            last -= 1
        if last:
            yield found(t.slice(0, last))
        held = [t.slice(last)]
    if held:
        yield found(pa.concat_tables(held))


def variant_groups(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, size: int = DICTIONARY, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), each word once.

    n_near: words one inserted, deleted or replaced code point away. form: that of them with the
    largest n (of equal ones the least in code-point order) where its n is at least ``factor``
    times the word's, else null; root: the last of the forms followed from the word, or the word.
    Words are compared by code points. An empty table gives no rows; null words take no part.
    """
    key = F.when(F.char_length("word") > LONG + 1, F.concat(F.lit("\0"), F.sha2(F.encode("word", "UTF-8"), 256))).otherwise(F.col("word"))
    words = stored(words.where("word IS NOT NULL").select("word", "n", key.alias("key")), "words")
    extended = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, qmin, qmax, size))
    length, text = F.char_length("word"), F.lit(None).cast("string")
    short = words.where(length <= LONG + 1).select("word", "n").mapInArrow(_ends(extended, qmin, qmax), "word string, n long, ends array<int>").select("word", "n", F.posexplode("ends").alias("at", "end"))
    left, head = F.substring("word", F.lit(1), F.col("end")), F.substring("word", F.lit(1), F.col("at"))
    filled = F.struct(F.substring("word", F.col("at") + 1, length).alias("right"), text.alias("letter"))
    changed = F.struct(F.substring("word", F.col("at") + 2, length).alias("right"), F.substring("word", F.col("at") + 1, F.lit(1)).alias("letter"))
    edits = F.array_compact(F.array(F.when(length <= LONG, filled), F.when(F.col("at") < length, changed)))
    short = short.select("n", "at", left.alias("left"), head.alias("head"), F.explode(edits).alias("x")) \
        .select("left", "x.right", "at", F.concat("head", "x.right").alias("rest"), "x.letter", text.alias("next"), text.alias("key"), "n")
    long = words.where(length > LONG).mapInArrow(_long_postings(extended, qmin, qmax), "left string, right string, at int, rest string, letter string, next string, key string, n long")
    posted = short.unionByName(long).select(F.xxhash64("at", "left", "right").alias("list"), "at", "rest", "letter", "next", "key", "n")
    near = posted.repartition("list").sortWithinPartitions("list", "at", "rest").mapInArrow(_near, "key string, near long, best_n long, best_key string")
    texts = words.where(length > LONG + 1).select(F.col("key").alias("of"), F.col("word").alias("full"))
    near = near.join(texts, F.col("best_key") == F.col("of"), "left").select("key", "near", "best_n", F.coalesce("full", "best_key").alias("best"))
    none = F.lit(None)
    rows = words.select("key", "word", "n", F.lit(0).cast("long").alias("near"), none.cast("long").alias("best_n"), none.cast("string").alias("best")) \
        .unionByName(near.withColumns({"n": none.cast("long"), "word": text}))
    top = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    known = rows.groupBy("key").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("near").alias("n_near"), F.max("best_n").alias("best_n"), top.alias("top"))
    formed = F.col("best_n") >= F.col("n") * factor
    known = stored(known.select("word", "n", "n_near", F.when(formed, F.col("top.best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to their ends. Each round doubles the steps; a step multiplies n, so rounds are few."""
    roots = stored(forms, "roots")
    while True:
        on = roots.select(F.col("word").alias("of"), F.col("root").alias("next"))
        longer = stored(roots.join(on, F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = longer.where("moved").limit(1).count()
        roots = longer.drop("moved")
        if not moved:
            return roots
