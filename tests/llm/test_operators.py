"""Each training-data operator on a small table with nulls, empty and long texts, ties, repeated
rows and clashing extra columns, held against brute force; and on empty tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from washkit.llm import hash_forest, minhash, packing, pu_quality, sharding, site_style, suffix_dedup, url_reputation, warc, winnow

from washkit.llm.common import hashed, word_codes
from washkit.llm.queries import op2_best_fit_packing

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


BASE, PASSAGE, ITEM = prose(1, 200), prose(2, 90), prose(3, 14)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w1 ", "W1 ")), (4, BASE + " tail"), (5, BASE + " tail"), (5, BASE + " tail"), (6, None), (7, ""), (8, " \n "), (9, "one two"), (10, "ONE two"),
    (11, prose(4, 60) + "\n" + PASSAGE + "\n" + prose(5, 40)), (12, PASSAGE + " " + prose(6, 300)), (13, "ab " * 500), (14, prose(7, 20) + " " + ITEM + "! " + prose(8, 20)),
    (15, prose(9, 4000)), (16, "é" * 300 + " Ünï " + PASSAGE), (None, prose(10, 50)), (17, ITEM.upper()), (18, prose(11, 30)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{(i or 0) % 3}" if i != 9 else None, "x", 1, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_shingles string, key int, row int").repartition(3)


def words(text, pattern=rb"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").encode().lower())


def test_near_duplicates(docs):
    sets = {}
    for i, t in TEXTS:
        w = words(t)
        if i is not None:
            sets[i] = {b" ".join(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), r


@pytest.mark.parametrize("size,block", [(400, 8192), (400, 1), (128, 2)])
def test_repeated_spans(docs, size, block):
    data = [(t or "").encode() for _, t in TEXTS]
    seen = {}
    for b in data:
        for j in range(len(b) - size + 1):
            seen[b[j:j + size]] = seen.get(b[j:j + size], 0) + 1
    want = []
    for (i, _), b in zip(TEXTS, data, strict=True):
        hit = np.zeros(len(b), bool)
        for j in range(len(b) - size + 1):
            if seen[b[j:j + size]] > 1:
                hit[j:j + size] = True
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        cut = np.flatnonzero(np.diff(np.r_[True, hit, True].astype(int)))
        whole = "".join(b[x:y].decode("utf-8", "ignore") for x, y in zip(cut[::2], cut[1::2], strict=True))
        want.append((i, len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), whole))
    got = [tuple(r) for r in suffix_dedup.report(suffix_dedup.repeated_spans(docs, min_bytes=size, block=block)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contamination(spark, docs, sent):
    items = [(1, ITEM), (1, ITEM), (2, "One, TWO"), (3, None), (4, "..."), (5, prose(12, 30)), (None, BASE)]
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items:
        w = words(t, pattern)
        for j in range(max(0, len(w) - min(10, len(w)) + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[j:j + 10]), set()).add(str(i))
    want = []
    for i, t in TEXTS:
        w, hit, found = words(t, pattern), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[tuple(w[j:j + k])]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    given = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in winnow.report(winnow.contamination(docs, given, broadcast_bytes=sent)).collect()]
    assert sorted(set(got), key=repr) == sorted(set(want), key=repr) and len(got) == len(want)


def test_sharding(docs):
    got = sharding.shard_by_bytes(docs, 4, fineness=4, cell=3).collect()
    assert len(got) == len(TEXTS)
    of, slots = {}, {}
    by_id = {i: (t or "").encode() for i, t in TEXTS}
    for r in got:
        text = by_id[r.doc_id]
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.law == "bytes" and r.grown_shard is None
        assert of.setdefault(text, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(50):
        weights = sorted(rng.integers(1, 60, 40).tolist(), reverse=True)
        bins, want = [], []
        for w in weights:
            fits = [(c, b) for b, c in enumerate(bins) if c >= w]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append(100)
            bins[b] -= w
            want.append(b)
        assert sharding.best_fit(weights, 100) == want
        sizes = np.bincount(sharding.pack_shards(weights, 5), weights=weights)
        assert sizes.max() - sizes.min() <= max(weights)


def test_packing(docs):
    got = packing.pack(docs, capacity=256, cell=8).collect()
    source = {i: f"src{(i or 0) % 3}" if i != 9 else None for i, _ in TEXTS}
    text = dict(TEXTS)
    bins, total = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_words
        assert r.n_words <= 256 and (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for i, t in TEXTS:
        assert total[i] == len(words(t)) * sum(j == i for j, _ in TEXTS)
    for rows in bins.values():
        assert sum(r.n_words for r in rows) <= 256 and sorted(r.slot for r in rows) == list(range(len(rows)))
        sources = [source[r.doc_id] for r in rows if source[r.doc_id]]
        texts = [(text[r.doc_id] or "").lower() for r in rows]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_packing_against_a_plain_search():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 60, 60).tolist(), reverse=True)
        sources, clusters = rng.integers(-1, 9, 60).tolist(), rng.integers(-1, 15, 60).tolist()
        bins, want = [], []
        for size, s, c in zip(sizes, sources, clusters, strict=True):
            fits = [(left, b) for b, (left, used, seen, _) in enumerate(bins) if left >= size and s not in used and c not in seen]
            b = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append((100, set(), set(), 0))
            left, used, seen, n = bins[b]
            bins[b] = (left - size, used | ({s} if s >= 0 else set()), seen | ({c} if c >= 0 else set()), n + 1)
            want.append((b, n))
        assert packing.pack_cell(sizes, sources, clusters, 100) == want


def test_near_copies_share_no_sequence(spark, tmp_path):
    rows = []
    for i in range(30):
        text = prose(700 + i, 120).split()
        for j in range(4):  # near copies from different sources
            rows.append((4 * i + j, " ".join([*text, "tail", str(j)] if j else text), f"src{j * 7 + i % 5}"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        assert r.doc_id // 4 not in seen.setdefault(r.bin, set())
        seen[r.bin].add(r.doc_id // 4)


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))


def test_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/a?x/", "http://a.example.com/en/", "http://b.com#f", "http://b.com/?q", "http://bad.example.org/1", "http://ok.example.org/1", "http://n.net/es", "http://n.net/es/?"]
    rows = [(i, u, "p") for i, u in enumerate(urls)] + [(100 + i, "http://bad.example.org/x", "p") for i in range(40)] + [(200 + i, "http://ok.example.org/x", "p") for i in range(40)] + [(None, "http://b.com/", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string")
    bad = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(40)] + [(200, 0), (201, None), (None, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, bad, RULES).collect()}
    assert len(got) == len(rows)
    said = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert said == [("", "", None, "allow")] * 4 + [
        ("www.example.com", "/en/a", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("b.com", "", None, "allow"), ("b.com", "/", "com/", "allow"),
        ("bad.example.org", "/1", None, "block"), ("ok.example.org", "/1", None, "allow"), ("n.net", "/es", None, "allow"), ("n.net", "/es/", "net/es/", "block")]
    assert {r.verdict for r in url_reputation.judge_urls(pages, bad.limit(0)).collect()} == {"allow"}


def test_levels_of_hosts(spark):
    hosts = {"a.b.shop.example.com:8080": ("example.com", "com"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "a.b.gov.br": ("b.gov.br", "gov.br"),
             "me@x.co.uk.": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"), "": ("", ""), "[::1]:80": ("[::1]", "[::1]"), "x.y.z.blog.org": ("blog.org", "org"),
             "a." * 3000 + "com": ("a.com", "com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_reputation.levels(df["host"])
    assert {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()} == hosts
    domain, suffix = url_reputation.levels(df["host"], suffixes=("blog.org", "z.blog.org", "shop.example.com"))
    got = {r.host: (r.d, r.s) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got["x.y.z.blog.org"] == ("y.z.blog.org", "z.blog.org") and got["a.b.shop.example.com:8080"] == ("b.shop.example.com", "shop.example.com")


@pytest.mark.parametrize("split", [64, 8 << 20])
def test_warc(spark, split):
    html = [None, "", "<p>a</p>", "<p>a</p>", "\x1f\x8b\x08 WARC/1.1\r\n\r\n", "x" * 300_000, "<p>a</p>", "ü"]
    rows = [(i, None if i == 2 else f"http://h/{i}\n", h, "r") for i, h in enumerate(html)] + [(None, "u", "<p>b</p>", "r")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, record_type string"), split=split).collect()
    assert len(got) == len(rows)
    payload = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        p = payload[r.page_id]
        same = [i for i in payload if i is not None and payload[i] == p] or [None]
        assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id in (None, max(same, key=lambda x: -1 if x is None else x)) else ("revisit", max(same)))
        assert bytes(r.payload) == (p if r.record_type == "response" else b"")


def test_main_text(spark):
    page = ("<html><head><title>t</title><body><nav>menu</nav><div class='cookie-notice'>c</div><article><h1>A &amp;  B</h1><p>one<b>two</b><br>three<p>four <span class=ad>AD</span>"
            "<div id=comments><p>no</div><script>if(1<2){'</p>'}</script><ul><li>x<li>y</ul></article><footer>f")
    boiler = [(100 + i, f"http://h.org/{i}", f"<body><div class=z9>Same on all pages</div><div><p>{prose(50 + i, 8)}</p></div></body>") for i in range(12)]
    rows = [(1, "http://a.org/", page), (2, None, None), (3, "http://a.org/x", "<!-- open"), (None, "http://a.org/y", "plain < text &lt;"), (1, "http://a.org/", page), *boiler]
    got = site_style.main_text(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "A & B\nonetwo three\nfour\nx\ny" and text[2] == "" and text[3] == "" and text[None] == "plain < text <"
    assert all(text[100 + i] == prose(50 + i, 8) for i in range(12))


def morse(n):
    """Two words of 2 ** n letters in Thue-Morse order, which a polynomial modulo a power of two cannot tell apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2**n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_codes_tell_words_apart():
    a, b = morse(12)
    assert len({int(c[0]) for c in word_codes([a.encode(), b.encode()])}) == 2
    rng = np.random.default_rng(9)
    found = {bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(1, 40, 3000)} | {b"\xff" * n for n in range(1, 40)}
    texts = sorted(found)
    data = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    codes = hashed(data, ends - [len(t) for t in texts], ends)
    assert len(set(codes.tolist())) == len(texts)
    alone = [int(hashed(t, np.array([0]), np.array([len(t)]))[0]) for t in texts]
    assert codes.tolist() == alone


def test_words_that_a_polynomial_confuses(spark):
    a, b = morse(9)
    nine = prose(91, 9)
    docs = spark.createDataFrame([(1, f"{nine} {a}"), (2, f"{nine} {b}"), (3, f"{nine} {a}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([("x", f"{nine} {a}"), ("y", b), ("z", a)], "item_id string, text string")
    for sent in (1 << 24, 0):
        hit = {r.doc_id: (r.n_hit, r.n_items) for r in winnow.report(winnow.contamination(docs, items, broadcast_bytes=sent)).collect()}
        assert hit == {1: (10, 2), 2: (1, 1), 3: (10, 2)}


def test_hits_count_words_that_are_equal():
    assert winnow.equal_runs([b"a"] * 12, [b"a"] * 12, 10) == [(0, 12)]
    assert winnow.equal_runs([b"a", b"b", b"c", b"d"], [b"a", b"x", b"c", b"d"], 2) == [(2, 4)]


ARTICLE = "<p>the story of it all</p><p>goes on for a while here</p>"


@pytest.mark.parametrize("page", [
    f"<body class='single has-sidebar'><article>{ARTICLE}</article></body>", f"<body><div id=content-with-sidebar><article>{ARTICLE}</article></div></body>",
    f"<body><article class='post related'>{ARTICLE}</article></body>", f"<body><article><form>{ARTICLE}</form></article></body>",
    f"<body><form id=aspnetForm><div><article>{ARTICLE}</article></div></form></body>", f"<body><article><div class='search-results'>{ARTICLE}</div></article></body>",
    f"<body class=search><main>{ARTICLE}</main></body>", f"<html class=modal><body><div class='related'><article>{ARTICLE}</article></div></body></html>",
    f"<body><div class='site-header'>x</div><article>{ARTICLE}<div class='ad-banner'>buy</div><form><p>mail</p></form></article><div class='related-posts'><article>teaser</article></div></body>",
    f"<body><main><div id=comments-list><article>first!</article></div><article>{ARTICLE}<section class='comments'><p>so true</p></section></article><aside><article>else</article></aside></main></body>",
    f"<body><article><span class=ad>buy<b>now</b></span>{ARTICLE}<div hidden>no</div><div aria-hidden=true>no</div></article></body>",
])
def test_names_of_noise(page):
    assert site_style.Page(page).main_text() == "the story of it all\ngoes on for a while here"


def test_a_deep_page_costs_no_more():
    page = "<div>" * 5000 + "<p>deep down</p>" + "</div>" * 5000 + "".join(f"<p>line {i}</p>" for i in range(3000))
    p = site_style.Page(page)
    assert p.main_text().startswith("deep down\nline 0\n") and len(list(p.counted())) == 5000 + 1 + 3000


def test_style_tree_counts(spark):
    pages = [("h", f"<body><div class=m>same</div><div class=c><p>{i // 2}</p></div></body>") for i in range(20)] + [("h", "<body><div class=m>same</div><div class=c><p>0</p></div></body>"), ("g", "<p>x")]
    nodes, contents = site_style.style_tree(spark.createDataFrame(pages, "host string, html string"), min_seen=1)
    count = {}
    for host, html in set(pages):
        for path, style, content in site_style.Page(html).counted():
            count.setdefault((host, path), []).append((style, content))
    entropy = lambda xs: 0.0 if len(xs) < 2 else sum(xs.count(x) * np.log(xs.count(x)) for x in set(xs)) / (len(xs) * np.log(len(xs)))
    got = {(r.host, r.path): (r.seen, r.importance) for r in nodes.collect()}
    assert set(got) == set(count)
    for k, found in count.items():
        styles, texts = ([f[i] for f in found] for i in (0, 1))
        assert got[k][0] == len(found) and abs(got[k][1] - (0.1 * (1 - entropy(styles)) + 0.9 * (1 - entropy(texts)))) < 1e-9
    assert {(r.host, r.path, r.value, r.c) for r in contents.collect()} == {(*k, v, [f[1] for f in found].count(v)) for k, found in count.items() for v in {f[1] for f in found}}


def test_search_is_exact_with_the_whole_share(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((900, 24))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000 + i, x[i][:3].tolist()) for i in range(4)], "vec_id long, embedding array<double>")
    got = {}
    for r in hash_forest.nearest(v, v.where("vec_id % 9 = 0 OR vec_id >= 5000"), block=200, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    for q in range(0, 900, 9):
        s = u @ u[q]
        s[q] = -9
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(900), -s))[:5].tolist()
    assert all(len(got[5000 + i]) == 3 for i in range(4))


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 16)).astype(np.float32).astype(float)
    x[7] = x[6]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0), (None, x[3].tolist(), 0), (3, x[3].tolist(), 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = hash_forest.nearest(v, v.where("vec_id % 50 = 6 OR vec_id > 9000"), k=5, block=1000).collect()
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hits = 0
    for q in range(6, 3000, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(best.tolist()))
    assert hits / len(got) >= 0.9 and len(got) == 300
    assert next(r for r in got if r.query_id == 6 and r["rank"] == 1).vec_id == 7


def test_quality(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        t, good = prose(100 + i, int(rng.integers(20, 80))), i % 5 != 0
        rows.append((i, t if good else " ".join(w + "$$$" for w in t.split()), 0.5))
        if i < 500:
            labels.append((i, int(good)))
    rows += [(1000, None, 0.5), (1001, "", 0.5), (None, prose(1, 30), 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    got = pu_quality.quality_scores(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= by[i].score <= 1 and by[i].predicted == int(by[i].score >= 0.3) for i in range(600))
    assert np.mean([by[i].predicted == int(i % 5 != 0) for i in range(600)]) > 0.95
    assert {r.score for r in pu_quality.quality_scores(docs, marks.limit(0)).collect()} == {0.5}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (minhash.near_duplicates(docs), suffix_dedup.repeated_spans(docs), sharding.shard_by_bytes(docs), packing.pack(docs), pu_quality.quality_scores(docs, labels),
               winnow.contamination(docs, docs.withColumnRenamed("doc_id", "item_id")), warc.round_trip(pages), site_style.main_text(pages), hash_forest.nearest(vectors, vectors),
               url_reputation.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int"), RULES)):
        assert df.collect() == []


def test_main_text_of_a_host_that_is_mostly_copies(spark):
    def page(text, more=""):
        return f"<body><div class=top>Same line here</div><article><div class=body><p>{text}</p></div><div class=tail>All rights kept</div>{more}</article></body>"

    copy, own = prose(300, 20), {i: prose(301 + i, 20) for i in range(10)}
    rows = [(i, "http://h.org/c", page(copy)) for i in range(190)] + [(200 + i, "http://h.org/a", page(own[i])) for i in range(10)]
    rows += [(300 + i, "http://n.org/", f"<body><div class=body><p>{copy}</p></div><p>{i}</p></body>") for i in range(20)]  # copies but for a number
    rows += [(400 + i, "http://m.org/", f"<body><div class=a><p>{'Mostly the same' if i < 190 else own[i - 190][:30]}</p></div><p>{prose(700 + i, 20)}</p></body>") for i in range(200)]
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == copy for i in range(190)) and all(got[200 + i] == own[i] for i in range(10))
    assert all(got[300 + i] == f"{copy}\n{i}" for i in range(20))
    assert all(got[400 + i] == ("" if i < 190 else own[i - 190][:30].strip() + "\n") + prose(700 + i, 20) for i in range(200))


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contamination_by_items_without_an_id(spark, docs, sent):
    items = spark.createDataFrame([(None, PASSAGE), (None, "one two"), (1, ITEM), (None, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in winnow.report(winnow.contamination(docs, items, broadcast_bytes=sent, null_items=True)).collect()}
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in ("", "1")}
    assert {i: (r.n_hit, r.n_items, r.items_sha256) for i, r in got.items() if r.contaminated} == {
        9: (2, 1, sha[""]), 10: (2, 1, sha[""]), 11: (90, 1, sha[""]), 12: (90, 1, sha[""]), 16: (90, 1, sha[""]), 14: (14, 2, sha["1"]), 17: (14, 2, sha["1"])}


def test_the_query_counts_items_without_an_id(spark, tmp_path):
    from washkit.llm.queries import REGISTRY

    spark.createDataFrame([(1, ITEM + " x"), (2, prose(12, 30))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = REGISTRY["op10_winnowing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got) == [(1, 14, 1, True), (2, 0, 0, False)]


def test_rows_that_share_an_id_are_sampled_one_by_one(spark, monkeypatch):
    seen, fit = [], pu_quality.fit
    monkeypatch.setattr(pu_quality, "fit", lambda pos, unl: (seen.append((len(pos), len(unl), unl)), fit(pos, unl))[1])
    rows = [(None, "$$$ $$$ $$$ !!") for _ in range(1000)] + [(i, prose(i, 20)) for i in range(1000)] + [(77, prose(9, 12)) for _ in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pu_quality.quality_scores(docs, spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id long, quality int"), sample=300).collect()
    pos, unl, x = seen[0]
    same = [int((x == row).all(axis=1).sum()) for row in np.unique(x, axis=0)]
    assert 200 < pos < 400 and 200 < unl < 400 and 2 == sum(50 < n < 150 for n in same) and sum(n > 50 for n in same) == 2
