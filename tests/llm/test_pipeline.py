"""The pipeline's stages on a small corpus against plain Python."""

from math import comb

import corpus_pipeline as cp
import pytest
from tests.llm.test_operators import ITEM, PASSAGE, prose, words
from washkit.llm import minhash


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    texts = {i: prose(500 + i, 40 + i % 50) for i in range(300)}
    for i in range(0, 300, 7):
        texts[i] = " ".join(w + "$$$" for w in texts[i].split())
    texts[1] = texts[2]
    texts[3] = texts[4] + " end"
    texts[5] = prose(1, 30) + " " + PASSAGE + " " + prose(2, 30)
    texts[6] = PASSAGE + " " + prose(903, 60)
    texts[8] = prose(8, 30) + " " + ITEM + " " + prose(9, 30)
    rows = [(i, t, "en", f"s{i % 9}", len(t)) for i, t in texts.items()]
    rows += [(301, texts[10] + " x", "en", None, 1), (302, texts[11], None, "s", None), (302, texts[11], None, "s", None), (303, None, "en", "s", 0), (None, prose(77, 60), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(280)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), texts


def test_stages(spark, corpus):
    at, texts = corpus
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, at), "stage")
        seen.append(docs.collect())
        if name != cp.STAGES[-1][0]:
            assert tuple(docs.columns) == cp.COLUMNS
    quality, near, passages, leaks, packed = seen
    ids = {r.doc_id for r in quality}
    assert all((i in ids) == (i % 7 != 0) for i in range(300)) and None in ids
    ids = [r.doc_id for r in near]
    assert {r.doc_id for r in quality} - set(ids) == {2, 4, 301, 302} - {i for i in (2, 4) if i % 7 == 0} and len(ids) == len(set(ids))
    left = {r.doc_id: r.text for r in passages}
    assert PASSAGE not in left[5] and PASSAGE not in left[6] and left[5].startswith(prose(1, 30)) and left[6].endswith(prose(903, 60)[5:]) and left[9] == texts[9]
    assert set(left) - {r.doc_id for r in leaks} == {8}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_words
    assert total == {r.doc_id: len(words(r.text)) for r in leaks}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, at, rows, labels=(), items=()):
    spark.createDataFrame(list(labels), "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def test_rows_with_a_null_or_repeated_id_go_by_their_own_text(spark, tmp_path):
    bad = " ".join(w + "$$$" for w in prose(70, 60).split())
    good = {i: prose(500 + i, 60) for i in range(300)}
    rows = [(i, t if i % 7 else " ".join(w + "$$$" for w in t.split())) for i, t in good.items()]
    rows += [(None, prose(71, 60)), (None, prose(72, 60)), (None, bad), (1, bad)]
    docs = written(spark, tmp_path, rows, [(i, int(i % 7 != 0)) for i in range(1, 280)], [(1, ITEM)])
    got = {(r.doc_id, r.text) for r in cp.quality(spark, docs, str(tmp_path)).collect()}
    assert {(None, prose(71, 60)), (None, prose(72, 60)), (1, good[1])} <= got and (None, bad) not in got and (1, bad) not in got

    rows = [(1, prose(73, 60)), (1, prose(74, 60)), (1, prose(74, 60)), (2, prose(74, 60) + " end"), (3, prose(73, 60)), (4, ""), (4, ""), (5, ""), (None, prose(75, 60)), (None, prose(76, 60))]
    got = cp.near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in {rows[0], rows[1], rows[5], rows[7], rows[8], rows[9]})

    rows = [(None, PASSAGE + " a " + prose(80, 30)), (None, prose(81, 30) + " " + PASSAGE), (None, prose(82, 40)), (None, PASSAGE), (2, PASSAGE + " b " + prose(83, 30)), (2, prose(84, 40))]
    got = {r.text.strip() for r in cp.repeated_passages(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), str(tmp_path)).collect()}
    assert got == {"a " + prose(80, 30), prose(81, 30), prose(82, 40), "b " + prose(83, 30), prose(84, 40)}

    rows = [(None, prose(85, 30)), (None, prose(86, 30) + " " + ITEM), (3, ITEM + " " + prose(87, 30)), (3, prose(88, 30))]
    got = {r.text for r in cp.benchmark_leaks(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA), str(tmp_path)).collect()}
    assert got == {prose(85, 30), prose(88, 30)}


def test_the_fit_brings_no_row_objects_of_the_sample_to_the_driver(spark, tmp_path, monkeypatch):
    docs = written(spark, tmp_path, [(i, prose(3000 + i, 20)) for i in range(400)], [(i, 1) for i in range(1, 300)])
    kind, rows = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (got := collect(self), rows.append(len(got)))[0])
    scores = cp.pu_quality.quality_scores(docs, cp.table(spark, str(tmp_path), "labels"))
    assert max(rows) == cp.pu_quality.WIDTH
    assert scores.count() == 400


def test_near_copies_from_a_similarity_of_four_fifths(spark, tmp_path):
    rows = []
    for i in range(40):  # 182 shingles each, 165 of them shared: J = 0.83
        w = prose(2000 + i, 190).split()
        rows += [(2 * i, " ".join(w[:186])), (2 * i + 1, " ".join([*w[:169], *(f"x{i}y{j}" for j in range(17))]))]
    sets = [{tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    assert all(0.8 <= len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) < 0.85 for i in range(40))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()) == list(range(0, 80, 2))


def test_a_pair_at_the_threshold_is_hardly_missed():
    for percent in (80, 85, 90):
        for n, k in zip((minhash.TOKENS, minhash.COORDINATES), minhash.must_agree(percent), strict=True):
            p = percent / 100
            assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k)) < 2e-6
    assert minhash.must_agree(85) == (38, 88)


def test_a_leak_of_an_item_without_an_id_goes(spark, tmp_path):
    docs = written(spark, tmp_path, [(1, prose(90, 30) + " " + ITEM), (2, prose(91, 40))], (), [(None, ITEM)])
    assert [r.doc_id for r in cp.benchmark_leaks(spark, docs, str(tmp_path)).collect()] == [2]


def test_only_characters_that_a_cut_broke_go(spark, tmp_path):
    # © is C2 A9 and é is C3 A9: the repeated bytes begin inside the ©
    rows = [(1, "one � a" + PASSAGE + "z � end"), (2, "two b" + PASSAGE + "y"), (3, "x©" + "é" * 150 + "q"), (4, "yé" + "é" * 150 + "w�"), (5, "plain �")]
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.repeated_passages(spark, spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], SCHEMA), str(tmp_path)).collect()}
    assert got[1] == ("one � az � end", 14) and got[2] == ("two by", 6) and got[5] == ("plain �", 9)
    assert got[3] == ("xq", 2) and got[4] == ("yw�", 3)
