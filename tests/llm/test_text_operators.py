"""Language ID, BPE, HTML and MinHash."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, html, langid, minhash, queries
from tests.llm.pages_by_hand import PAGES

FILE = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
REFERENCE = Tokenizer.from_str(FILE)
CODEC, SMALL = bpe.Codec(FILE), bpe.Codec(FILE, short=3, most=5, chars=7)


def ids(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("abcdefth \n\t'sre<|endoftext|>0129é中\x1c\x85 　")))
def test_bpe_equals_the_library(text):
    want = REFERENCE.encode(text, add_special_tokens=False).ids
    assert ids(CODEC, text) == want and ids(SMALL, text) == want
    assert "".join(CODEC.decode(CODEC.encode(text))) == REFERENCE.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", "ing", "the", "=-", " \n", "é", "0"])
def test_bpe_of_long_runs(unit):
    for n in (1, 2, 3, 63, 64, 65, 127, 500, 5000):
        assert ids(SMALL, unit * n) == REFERENCE.encode(unit * n, add_special_tokens=False).ids


CONTRACTIONS = "they're we'll I've don't he'd I'm it's ''re 'll 'rest '  've\n'r'e ''''ll  x'l l'' 'v e're12're!'re  'the 'Re"


def test_words_that_come_again_are_encoded_once():
    """Corpora with many rare words: 240,000 of them are still remembered when they come again."""
    codec, words = bpe.Codec(FILE), [f" {k:x}q" for k in range(240_000)]
    first = [codec[w] for w in words]
    codec._start = None  # what is encoded anew would call it
    assert [codec[w] for w in words] == first


@pytest.mark.parametrize("chars", range(2, 14))
def test_bpe_windows_may_end_anywhere(chars):
    """Every window length and shift over a text full of contractions, blanks and quotes."""
    narrow = bpe.Codec(FILE, chars=chars)
    for shift in range(len(CONTRACTIONS)):
        text = CONTRACTIONS[shift:]
        assert ids(narrow, text) == REFERENCE.encode(text, add_special_tokens=False).ids, text


def test_bpe_contraction_across_a_whole_window():
    text = "a" * 65_534 + "'re here " + "b" * 65_527 + "'ll x"
    assert ids(CODEC, text) == REFERENCE.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_bounded():
    reader = bpe.Transducer(CODEC.table)
    most = 0
    for _ in range(200):
        reader.feed(b"abcde" * 200)
        most = max(most, len(reader.window))
    assert most < 20 * CODEC.table.lookahead
    assert len(SMALL) <= SMALL.most and len(SMALL.older) <= SMALL.most


def test_bpe_of_awkward_documents(spark, awkward, awkward_rows, empty):
    out = bpe.encode_decode(awkward, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = Counter((i, tuple(REFERENCE.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in awkward_rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in out) == want
    assert bpe.encode_decode(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bpe_digests(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op6_bpe(spark, data).collect():
        want = REFERENCE.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_held_out_accuracy(spark, data):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = queries.op1_language_id(spark, data).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(docs) and 0.1 < len(held) / len(out) < 0.4
    assert np.mean([docs[r.doc_id] == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_learns_nothing_from_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(spoiled)
    assert a.langs == b.langs and np.allclose(a.centroids, b.centroids) and np.allclose(a.idf, b.idf)


def test_language_of_awkward_documents(awkward, empty):
    model = langid.fit(awkward)
    out = {r.doc_id: r for r in langid.identify(awkward.drop("language"), model).select("doc_id", "language.*").collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (100, 101, 102, 103)) and out[104].lang_pred == "en" and out[401].accepted
    assert langid.fit(empty).langs == [] and langid.identify(empty.drop("language"), langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward.drop("language"), langid.fit(empty)).select("language.*").collect()} == {"und"}


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Straße, naïve — 東京 12 𐐀𐐁 end" * 50
    whole, found = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_PIECE", 37)
    assert found and (langid.ngram_counts(text)[0] == whole).all()


def naive_grams(text):
    """Hashed letter n-grams of a text, one by one."""
    points, counts = [0], Counter()
    for c in (text or "").lower():
        p = ord(c) if c.isalpha() else 0
        if p or points[-1]:
            points.append(p)
    points += [0]
    for order in langid.ORDERS:
        for i in range(len(points) - order + 1):
            code = order
            for p in points[i : i + order]:
                code = (code ^ p) * 0x9E3779B1 & 0xFFFFFFFF
                code ^= code >> 15
            counts[code % langid.DIMS] += 1
    return counts


def test_language_against_a_naive_model(spark, data):
    """Document frequencies, weights, cosines, labels and the centroids' own rule, all by plain loops."""
    import math
    import zlib

    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    taught = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(spark.read.parquet(f"{data}/documents.parquet"))
    held = Counter(d for r in taught for d in naive_grams(r.text))
    idf = [math.log((1 + len(taught)) / (1 + held[d])) + 1 for d in range(langid.DIMS)]
    assert np.allclose(model.idf, idf)

    def vector(text):
        v = np.zeros(langid.DIMS)
        for d, n in naive_grams(text).items():
            v[d] = math.log(1 + n) * idf[d]
        return v / math.sqrt(sum(x * x for x in v))

    vectors = {r.doc_id: vector(r.text) for r in rows if any(c.isalpha() for c in r.text or "")}
    for r in queries.op1_language_id(spark, data).collect():
        if r.doc_id in vectors:
            cosines = [float(vectors[r.doc_id] @ c) for c in model.centroids]
            best = max(range(len(cosines)), key=cosines.__getitem__)
            assert r.lang_pred == model.langs[best] and r.score == pytest.approx(min(1, max(0, cosines[best])), abs=1e-9)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    for lang in set(model.langs):  # every document of the table is in the sample: centroids are the means of their own members
        centres = model.centroids[[i for i, x in enumerate(model.langs) if x == lang]]
        own = np.stack([vectors[r.doc_id] for r in taught if r.lang == lang and r.doc_id in vectors])
        near = (own @ centres.T).argmax(axis=1)
        moved = [centre @ (mean := own[near == k].sum(axis=0)) / np.linalg.norm(mean) for k, centre in enumerate(centres) if (near == k).any()]
        assert min(moved) > 0.98


def test_language_rejects_junk_and_keeps_prose(spark, data):
    import random

    rng, docs = random.Random(1), spark.read.parquet(f"{data}/documents.parquet".replace("sf0.001", "sf0.01"))
    model = langid.fit(docs)
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 200)]
    junk += ["жзщ ъыьэ ююя " * 40, "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=900)), "xq zv wkj " * 50]
    assert [accepted for _, _, accepted in model.predict(junk)] == [False] * len(junk)
    texts = [r.text for r in docs.where("text is not null").collect()]
    assert np.mean([accepted for _, _, accepted in model.predict(texts)]) > 0.999


def test_a_sample_is_bounded(spark):
    from tessera.llm.sampling import bounded_sample

    df = spark.createDataFrame([("a", i % 7) for i in range(500)] + [("b", i) for i in range(20)], "g string, x int")
    counts = {"a": 500, "b": 20}
    out = Counter(r.g for r in bounded_sample(df, "g", counts, ["x"], 30, 1).collect())
    assert out["a"] <= 30 and out["b"] == 20
    rows = lambda df: sorted((r.g, r.x) for r in bounded_sample(df, "g", counts, ["x"], 30, 1).collect())
    assert rows(df) == rows(df.repartition(3))
    assert bounded_sample(df.limit(0), "g", {}, ["x"], 30, 1).count() == 0


PAGE = """<!doctype html><html><head><title>T &amp; U</title><script>if (a < b) document.write("<p>no</p>");</script><style>p{}</style></head>
<body class="has-sidebar"><header><nav><a href=/>Home</a> <a href=/x>More</a></nav></header><div class="cookie-banner">We use cookies on this site and you can read all about it here.</div>
<article><h1>Old &lt;town&gt;</h1><!-- <p>hidden</p> --><p>First&nbsp;line
 of <b>the</b>&#32;story, which is long enough to be a paragraph of its own.<p>Short.<br>One more.</p>
<div class=ad>Buy now and save money on all the things that you want.</div><blockquote>Said &quot;he&quot;.</blockquote>
<section id=comments><p>What a great story, I really liked it a lot and so did he.</p></section></article>
<aside><p>Something else that is also quite long and has nothing to do with it.</p></aside><form><input><p>Write to us today.</p></form><footer>&copy; all rights reserved by the people who made this page.</footer></body></html>"""


def test_article_is_extracted():
    text, kept, seen = html.main_text(PAGE, html.train())
    assert text == 'Old <town>\nFirst line of the story, which is long enough to be a paragraph of its own.\nShort. One more.\nSaid "he".' and kept == 4 < seen


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "</p></div>", "<a" * 1000, "<p>" * 1000 + "x", "&#xFFFFFFFF;", "<style>p{}"])
def test_broken_pages_do_not_fail(page):
    text, _, _ = html.main_text(page, html.train())
    assert isinstance(text, str)


def share_right(pages):
    rows, labels = html.table_rows(pages)
    return np.mean([html.train().predict(r) == (label > 0.5) for r, label in zip(rows, labels)])


def test_tree_on_pages_it_has_not_seen():
    assert share_right(html.labelled(200, seed=11)) > 0.99 and share_right(PAGES) > 0.97


def test_words_and_link_density_decide():
    """All of them stand in nodes of the tree; without them it is far worse, without names it still works on pages without such names."""
    used, todo = set(), [html.train()]
    while todo:
        node = todo.pop()
        if node.at >= 0:
            used.add(html.FEATURES[node.at])
            todo += [node.low, node.high]
    assert {"words", "links", "words_before", "links_before", "words_after", "links_after"} <= used
    rows, labels = html.table_rows(html.labelled(100, seed=12))
    plain = (rows[:, html.FEATURES.index("name")] == 0) & (rows[:, html.FEATURES.index("frame")] == 0) & (rows[:, html.FEATURES.index("article")] == 0)
    right = lambda x: np.mean([html.train().predict(r) == (label > 0.5) for r, label in zip(x[plain], labels[plain])])
    blind = rows.copy()
    blind[:, :6] = np.median(rows[:, :6], axis=0)
    assert right(rows) > 0.98 and right(blind) < 0.9


def test_features_against_brute_force():
    page = '<nav><a href=/>Home page</a> now</nav><div class="ad">Buy.</div><article><h1>Big <a href=/x>news</a></h1><ul><li>One two three</li></ul></article>'
    rows = [dict(zip(html.FEATURES, r)) for r in html.feature_rows(html.blocks_of(page))]
    texts, links = ["Home page now", "Buy.", "Big news", "One two three"], [2 / 3, 0, 1 / 2, 0]
    for i, r in enumerate(rows):
        at = lambda x, k: x[k] if 0 <= k < len(x) else 0
        assert [r["words"], r["words_before"], r["words_after"]] == [len(at(texts, k).split()) if at(texts, k) else 0 for k in (i, i - 1, i + 1)]
        assert [r["links"], r["links_before"], r["links_after"]] == pytest.approx([at(links, k) for k in (i, i - 1, i + 1)])
    assert [r["frame"] for r in rows] == [1, 0, 0, 0] and [r["name"] for r in rows] == [0, 2, 0, 0] and [r["article"] for r in rows] == [0, 0, 1, 1]
    assert [r["heading"] for r in rows] == [0, 0, 1, 0] and [r["item"] for r in rows] == [0, 0, 0, 1] and [r["sentence"] for r in rows] == [0, 1, 0, 0]


def test_names_inside_prose_do_not_drop_it():
    long = "The council met on Tuesday and agreed to wait for the report on the quay before it decides."
    for name in ("more", "legal-history", "related", "form", "read-more story", "ad-hoc"):
        page = f'<div><h1>Town news</h1><p>Rain fell.</p><p class="{name}">{long}</p><p>{long}</p></div><div><a href=/1>One</a> <a href=/2>Two</a></div>'
        assert html.main_text(page, html.train())[0] == f"Town news\nRain fell.\n{long}\n{long}", name
    wrapped = f"<form id=page><nav><a href=/>Home</a></nav><article><h1>Town</h1><p>{long}</p><form><p>{long}</p></form></article></form>"
    assert html.main_text(wrapped, html.train())[0] == f"Town\n{long}"


@pytest.mark.parametrize("unit", ["<a", '<a "', "<a '", "<!", "<a <", "<p", "<p>", "&", "<!--", "</"])
def test_tokens_take_time_linear_in_the_page(unit):
    import time

    began = time.process_time()
    html.main_text(unit * (1_000_000 // len(unit)), html.train())
    assert time.process_time() - began < 10


def test_pages_of_a_table(spark, data):
    import re
    from html import unescape

    for r in queries.op8_html_text(spark, data).collect():
        assert r.n_chars == len(r.text)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op8_html_text(spark, data).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p)
    odd = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5)], "page_id bigint, url string, html string, text int")
    assert [(r.text, r.n_chars) for r in html.extract_text(odd).collect()] == [("", 0), ("", 0)] and html.extract_text(odd.limit(0)).count() == 0


def jaccard_groups(rows, words, percent):
    """Component of every row by comparing all pairs of sets of words."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, ids_ = [], []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        k = min(words, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
        ids_.append(i)
    parent = {i: i for i in ids_}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(ids_[a]), root(ids_[b])))
                parent[y] = x
    return {i: root(i) for i in ids_}, Counter((i, len(s)) for i, s in zip(ids_, sets))


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, awkward, awkward_rows, words, percent):
    rng = np.random.default_rng(1)
    stem = [f"w{x}" for x in rng.integers(0, 500, 120)]
    edits = []
    for i in range(60):  # copies that differ by a little more or less than the threshold
        copy = list(stem)
        for at in rng.integers(0, 120, int(rng.integers(0, 8))):
            copy[at] = f"e{i}_{at}"
        edits.append((1000 + i, " ".join(copy)))
    rows = [(r[0], r[1]) for r in awkward_rows if r[0] is not None] + edits
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(edits, "doc_id bigint, text string")).withColumn("rep", F.lit(1)).withColumn("component_id", F.lit(2))
    want, sizes = jaccard_groups(rows, words, percent)
    out = minhash.near_duplicates(docs, words, percent, block=8).collect()
    named = [r for r in out if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in named} == want and Counter((r.doc_id, r.n_shingles) for r in named) == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in named) and [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
        b = np.concatenate([a[:120], rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
        x, y = minhash.super_minhash([a, b])
        errors.append((x == y).mean() - 120 / 180)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (2 / 3 * 1 / 3 / minhash.SLOTS) ** 0.5
    assert (minhash.super_minhash([a[:1]]) != minhash._EMPTY).all()


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = "Alpha  beta\tGAMMA delta-é " * 40
    whole = minhash.shingles(text, 3)
    monkeypatch.setattr(minhash, "_CHUNK", 50)
    minhash._powers.cache_clear()
    assert (minhash.shingles(text, 3) == whole).all() and len(minhash.shingles(" \n", 3)) == 0 and len(minhash.shingles("one two", 3)) == 1
    minhash._powers.cache_clear()


def test_pages_without_ends_of_head_and_raw_elements():
    """Omitted </head> and <body>, raw elements that nothing closes, and the text of math and object."""
    text = lambda page: " ".join(b.text for b in html.blocks_of(page))
    assert text("<html><head><title>T <b></title><style>p</style><article><p>One.</p><p>Two.</p></article>") == "One. Two."
    for tag in ("noscript", "iframe", "svg", "template", "canvas", "textarea"):
        assert text(f"<div><p>One.</p><div><{tag}><i>hidden</i></div><p>Two.</p></div>") == "One. Two.", tag
    assert text("<head><noscript><link></head><body><p>One.</p></body>") == "One."
    assert text("<p>Let <math><mi>x</mi><annotation>tex</annotation></math> be <object>two</object>.</p>") == "Let x be two."
    assert text("<p>One.</p><svg><g><text>t</text></g></svg><script>'</p>'</script><p>Two.</p>") == "One. Two."
