"""Spelling variants against a comparison of all words; gram bounds; nulls, ties, chains, empty tables."""

import re
import zlib
from collections import Counter
from random import Random

from washkit.llm import spelling as S
from washkit.llm.queries import op13_spelling_variants


def near(a, b):
    """Whether one inserted, deleted or replaced code point parts two words."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def expected(counts, factor=10):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= factor * n else None
        out[w] = [form, None, n, len(others), counts[form] if form else None]
    for w, v in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        v[1] = root
    return {w: tuple(v) for w, v in out.items()}


def grouped(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def vocabulary(seed, size=350, letters="abé", length=(3, 9)):
    rnd = Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(*length))): 10 ** rnd.randint(0, 5) + rnd.randint(0, 2) for _ in range(size)}


def test_against_all_pairs(spark):
    for seed, letters in ((1, "ab"), (2, "abé"), (3, "abcdefgh")):
        counts = vocabulary(seed, letters=letters)
        df = spark.createDataFrame([(w, n, 1, "x", 2) for w, n in counts.items()] + [(None, 5, 1, "x", 2)], "word string, n long, near int, list string, at int").repartition(4)
        for size in (1, 20, 4096):
            assert grouped(S.variant_groups(df, size=size)) == expected(counts)


def test_repeated_letters_and_ties(spark):
    counts = {"aaaaaaa": 1, "aaaaaaaa": 20, "aaaaaaaaa": 300, "baaaaaa": 20, "aaabaaa": 20, "zzzzzzz": 1, "zzzzzzy": 10, "zzzzzzx": 10, "zzzzzz": 10, "lonelyword": 3, "😀aaaaaa": 20, "": 4, "x": 2, "y": 40}
    assert grouped(S.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == expected(counts)


def test_long_words(spark):
    rnd = Random(3)
    base = "".join(rnd.choice("abc") for _ in range(140))
    counts = {}
    for size in (62, 63, 64, 65, 66, 67, 140):
        w = base[:size]
        counts |= {w: 500, w + "a": 40, "b" + w: 40, w[:30] + "z" + w[30:]: 40, w[:30] + "z" + w[31:]: 7, w[:30] + "y" + w[31:]: 7, w[:50] + w[51:]: 7, w[:-1]: 900}
    counts |= {"a" * 3000: 5, "a" * 3001: 50, "a" * 1500 + "b" + "a" * 1500: 50, "a" * 2999: 50}
    assert grouped(S.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long"))) == expected(counts)


def test_forms_are_followed_to_the_end(spark):
    chain = {"w" + "a" * k: 10 ** (k - 1) for k in range(1, 18)}
    got = grouped(S.variant_groups(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == expected(chain) and {v[1] for v in got.values()} == {"w" + "a" * 17}


def test_one_hot_list(spark):
    counts = {"inter" + a + b: 2 + (a == b) * 30 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyzé"}
    assert grouped(S.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))) == expected(counts)


def test_what_an_edit_leaves_is_shared():
    rnd = Random(5)
    for _ in range(400):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 10)))
        grams = {word[p:p + q] for p in range(len(word)) for q in (2, 3, 4) if rnd.random() < 0.6}
        extended = frozenset(g for g in grams if all(g[:k] in grams for k in range(2, len(g))))
        ends = S.left_ends(word, extended)
        for i in range(len(word) + 1):
            assert ends[i] <= i
            for other in (word[:i] + "b" + word[i:], word[:i] + "b" + word[i + 1:], word[:i] + word[i + 1:]):
                if i <= len(other):
                    assert S.left_ends(other, extended)[i] == ends[i]


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(w, n) for w, n in vocabulary(7, 300, "abcdef").items()], "word string, n long")
    for size in (1, 5, 50):
        by = Counter(len(g) for g in S.gram_dictionary(words, size=size))
        assert set(by) <= {2, 3, 4} and all(c <= size for c in by.values())
    assert S.gram_dictionary(words.limit(0)) == frozenset()


def test_no_words(spark):
    assert S.variant_groups(spark.createDataFrame([], "word string, n long")).collect() == []


def test_the_query_on_documents(spark, tmp_path):
    rnd = Random(11)
    base = ["".join(rnd.choice("abcdeéÿ×") for _ in range(rnd.randint(6, 9))) for _ in range(25)]
    texts = [" ".join(rnd.choice(base) if rnd.random() < 0.8 else rnd.choice(base).upper() for _ in range(200)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0] + " ÉÉABCDEF éabcdefg"), (3, texts[3]), (99, None), (98, ""), (97, "1 2 3"), (96, "z" * 50000 + " " + "z" * 50000), (95, "Ābcdefgh")]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = grouped(op13_spelling_variants(spark, str(tmp_path)))
    assert got == expected(counts) and len(got) > 30
