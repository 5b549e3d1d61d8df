"""The text operators against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import os
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from compare import connect, differences  # noqa: E402
from tareline.llm import bpe, decontaminate, html_text, jaccard, licenses, quality, queries, sharding, toxicity, warc, winnowing  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 60_000
#: Null and empty texts, blanks, repeats and ties, a very long text, and a clashing extra column.
ODD = [
    (1, None, "x"), (2, "", "x"), (3, "   \n ", "x"), (4, "one two three", "x"), (5, "one two three", "x"), (5, "one two three", "x"),
    (6, LONG, "x"), (7, "Ein kürzerer Text, É!", None), (None, "no id here", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def result(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


# -- 1: BPE

def reference(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)


def test_op1_equals_the_library(spark, documents):
    got = result(spark, "op1_bpe").set_index("doc_id")
    library = Tokenizer.from_file(PATH)
    for i, text in zip(documents.doc_id, documents.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(got.loc[i]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        )


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("etaoinsrhl 'd!", max_size=80))
def test_bpe_of_any_text(text):
    ids = reference(text).ids
    assert np.frombuffer(bpe.encoder(PATH).encode([text])[0], "<u4").tolist() == ids


def test_bpe_special_tokens_and_separators():
    for text in ("a<|endoftext|>b", "<|startoftext|>", "x\x1cy z", "Σίσυφος ΣΑΣ", "a" * 5000):
        assert np.frombuffer(bpe.encoder(PATH).encode([text])[0], "<u4").tolist() == reference(text).ids


def test_bpe_odd_rows(odd, empty):
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert len(rows) == len(ODD) and rows[0]["n_tokens"] == 0 and rows[0]["decoded"] == ""
    assert [r["score"] for r in rows].count(None) == 1
    assert bpe.encode(empty, PATH).count() == 0


# -- 2 and 9: classifiers

def labelled_corpus(spark, bad):
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(words, 40)) + "."
        y = int(i % 5 == 1)
        docs.append((i, bad(text) if y else text))
        labels.append((i, 1 - y, y))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_learns_words_on_the_other_folds(spark):
    docs, labels = labelled_corpus(spark, lambda t: t.replace("beta", "zorkaris", 2))
    d = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id]).all()
    held = d[d.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and d.score.between(0, 1).all()


def test_quality_learns_shapes_on_the_other_folds(spark):
    docs, labels = labelled_corpus(spark, lambda t: t.replace(" ", "%%% "))
    d = quality.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (d.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in d.doc_id]).all()
    held = d[d.held_out]
    assert (held.predicted == held.quality).mean() > 0.97 and d.score.between(0, 1).all()


@pytest.mark.parametrize("model, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd, empty, model, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (6, None, None), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert model(odd, labels).count() == len(ODD)
        assert model(empty, labels).count() == 0


def test_classifiers_in_stages_keep_columns(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.remove_toxic(odd, labels).columns == odd.columns
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    d = quality.quality(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).toPandas()
    d = d.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (d.predicted == d.quality)[d.held_out].mean() > 0.95


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    d = toxicity.toxicity(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).toPandas()
    d = d.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = d[d.held_out]
    print("held-out toxicity", (held.predicted == held.toxic).mean(), ((held.score - held.toxic) ** 2).mean(), len(held))
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((held.score - held.toxic) ** 2).mean() < 0.04 and abs(held.score.mean() - held.toxic.mean()) < 0.03


def test_toxicity_of_noise_is_not_overconfident(spark):
    """Labels that do not follow from the texts give scores near their share, also for few rows."""
    rng = np.random.default_rng(11)
    docs = [(i, " ".join(f"w{chr(97 + a)}{chr(97 + b)}o" for a, b in rng.integers(0, 26, (60, 2))) + "!" * int(rng.integers(0, 9))) for i in range(160)]
    labels = [(i, 0, int(rng.random() < 0.3)) for i in range(160)]
    d = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"),
                          spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    print("noise", d.score.min(), d.score.max(), d.score.std())
    assert d.score.std() < 0.2


def test_isotonic_is_monotone():
    from tareline.llm.boosting import Isotonic

    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    steps = Isotonic().fit(x, (x + rng.normal(size=300) > 0).astype(float))
    assert (np.diff(steps(np.sort(x))) >= 0).all()


# -- memory, time and names

def test_bpe_of_very_long_words(spark):
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefgh"), 80_000))
    text = f"{word}z {word}y"
    coder = bpe.Bpe(PATH)
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert coder.encode([text, "short " + text])[0] == np.array(ids, "<u4").tobytes()
    assert max(map(len, coder.chunks)) <= bpe.LONG
    coder.forget()
    assert not (coder.chunks or coder.pairs or coder.final_pairs) and coder.encode(["short"]) == bpe.Bpe(PATH).encode(["short"])


def test_bpe_calls_little_per_word_and_forgets_steps(monkeypatch):
    words = [f"{a}{b}{c}" for a in ("un", "re", "inter", "zz") for b in ("ver", "lich", "qx", "tion") for c in ("able", "en", "w", "ness", "'s")]
    coder, rules = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    coder.encode([" ".join(words)])
    coder.chunks.clear()
    calls = []
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        coder.encode([" ".join(words)])
    finally:
        sys.setprofile(None)
    assert len(calls) < 4 * len(words)  # once pairs and steps are known, a letter needs no call
    monkeypatch.setattr(bpe, "MAX_STEPS", 3)
    small = bpe.Bpe(PATH)
    for word in words:
        assert np.frombuffer(small.encode([word])[0], "<u4").tolist() == rules.encode(word, add_special_tokens=False).ids
    assert len(small.steps) <= 3


def test_bpe_in_one_pass_equals_both_steps(odd, empty):
    for df in (odd, empty):
        both, one = bpe.decode(bpe.encode(df, PATH), PATH), bpe.encode_and_decode(df, PATH)
        assert one.columns == both.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, both.collect()))


def test_bpe_forgets_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_LETTERS", 10)
    coder, rules = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    for text in ("some words go", "other words come", "some words go"):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == rules.encode(text, add_special_tokens=False).ids
        assert coder.letters_kept <= 10 + len(text)


@pytest.mark.parametrize("page", [
    "<article class='" + "post__entry--" * 5000 + "'><p>Hello there, reader.</p></article>",
    "<div>" * 20_000 + "</b>" * 20_000 + "<p>Hello there, reader.</p>",
    "<b>" * 50_000 + "</i>" * 50_000,
])
def test_pages_with_long_names_or_unmatched_ends_take_no_time(page):
    start = time.perf_counter()
    html_text.blocks(page)
    assert time.perf_counter() - start < 5


def test_columns_called_like_results_are_replaced(spark):
    pages = spark.createDataFrame([(1, "<article><p>One two three four.</p></article>", "old")], "page_id long, html string, text string")
    got = html_text.extract(pages)
    assert got.columns.count("text") == 1 and got.first()["text"] != "old" and got.first()["page_id"] == 1
    docs = spark.createDataFrame([(1, "one two", "old", 7)], "doc_id long, text string, IDS string, `a.b` int")
    coded = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert coded.columns == ["doc_id", "text", "a.b", "n_tokens", "ids", "decoded"] and coded.first()["decoded"]


def test_keep_first_leaves_one_row_of_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text, "a"), (5, text, "a"), (6, text, "b"), (7, None, "c"), (7, "", "c"), (8, "other words than those above here", "d"),
            (None, "no id and words of its own", "e")]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(5, text, "a"), (7, None, "c"), (8, rows[5][1], "d"), (None, rows[6][1], "e")], key=str)


# -- 3: licenses

def test_op3_equals_sql(spark):
    assert differences(licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")), connect(SF), licenses.scan_sql()) == []


def test_licenses_phrases_and_templates(spark, empty):
    mit = next(t for t, x in licenses.TEMPLATES.items() if x == "mit")
    changed = mit.replace("free of charge", "wholly free of any charge").title()
    rows = [(1, "CC-BY, cc by cc by"), (2, "the General\nPublic  License. all rights all rights reserved"), (3, f"x {changed} y"),
            (4, None), (5, "cc"), (6, "cc x by"), (6, "cc x by")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 4, "cc-by")
    assert (got[2]["n_base"], got[2]["base_labels"]) == (2, "gpl,reserved") and got[2]["last_word"] == 6
    assert (got[3]["n_base"], got[3]["labels"], got[3]["first_word"]) == (0, "mit", None) and got[3]["score"] > 0.6
    assert got[4]["n_words"] == 0 and got[5]["labels"] == "" and got[6]["score"] == 0.0 and len(got) == 6
    assert licenses.scan(empty).count() == 0


def test_licenses_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (licenses.votes(docs, spark, licenses.PHRASES, licenses.TEMPLATES), licenses.scan(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("EvalPython", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct", "NestedLoop"))


def test_licenses_odd_rows(odd):
    got = licenses.scan(odd).toPandas()
    assert len(got) == len(ODD)  # rows that repeat id and text stay
    assert got.n_words.max() == 60_000


APACHE = next(t for t, x in licenses.TEMPLATES.items() if t.startswith("licensed under the apache"))


@pytest.mark.parametrize("text, label, score", [
    (f"{APACHE} " + "the license " * 20, "apache-2.0", 1.0),
    ("the license " * 20 + APACHE, "apache-2.0", 1.0),
    ("in compliance with the license " * 6, "", 0.0),
    ("under the apache license the license " * 4, "", 0.0),
    (" ".join(reversed(APACHE.split())), "", 0.0),
])
def test_licenses_verify_each_run_once_and_in_order(spark, text, label, score):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = licenses.scan(docs).first()
    assert (got["labels"], got["score"]) == (label, score)


def brute_licenses(text, templates, merge=licenses.MERGE, cover=licenses.COVER):
    words, found = text.split(), {}
    for template, label in templates.items():
        own = template.split()
        runs = list(zip(own, own[1:]))
        at = [[i for i in range(len(words) - 1) if (words[i], words[i + 1]) == run] for run in runs]
        for d in {i - j for j, places in enumerate(at) for i in places}:
            n, last = 0, None
            for j, places in enumerate(at):
                near = [(abs(i - j - d), i) for i in places if abs(i - j - d) <= merge]
                if near and (last is None or min(near)[1] > last):
                    n, last = n + 1, min(near)[1]
            if n / len(runs) >= cover:
                found[label] = max(found.get(label, 0), n / len(runs))
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def test_licenses_equal_brute_force_on_changed_templates(spark, tmp_path):
    rng, long = np.random.default_rng(5), " ".join(f"w{k % 90}" for k in range(150))
    templates = {**licenses.TEMPLATES, long: "long"}  # more runs than one number holds
    texts = []
    for k in range(150):
        words = list(templates)[k % len(templates)].split()
        for _ in range(int(rng.integers(0, 9))):
            i = int(rng.integers(0, len(words)))
            words[i : i + int(rng.integers(0, 3))] = rng.choice(["the", "license", "with", "x"], int(rng.integers(0, 3))).tolist()
        texts.append(" ".join(["the license"] * int(rng.integers(0, 4)) + words + ["with the license"] * int(rng.integers(0, 4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs, {}, templates).collect()}
    want = {k: brute_licenses(t, templates) for k, t in enumerate(texts)}
    assert got == want and sum(not x for x, _ in want.values()) > 5 and sum(bool(x) for x, _ in want.values()) > 50
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = connect(SF)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert differences(licenses.scan(docs, None, templates), con, licenses.scan_sql(None, templates)) == []


def test_licenses_need_two_words():
    with pytest.raises(ValueError, match="two words"):
        licenses.template_rows({"gpl": "gpl"}, {})


# -- 4: Jaccard

def brute_components(rows):
    """Component per (id, text) row; rows that repeat an id are one node."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return {(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))}


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for at in rng.choice(len(words), edits):
            words[at] = f"w{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


def test_op4_equals_brute_force(spark, documents):
    got = {tuple(r) for r in result(spark, "op4_jaccard").itertuples(index=False)}
    assert got == brute_components([*zip(documents.doc_id, documents.text)])


def test_jaccard_with_hot_passages_and_large_groups(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"t{rng.integers(10**5)}"
    passage, base = (" ".join(word() for _ in range(n)) for n in (40, 80))
    texts = copies(rng, base, 130, 1) + copies(rng, base, 40, 3) + [base] * 80
    texts += [f"{' '.join(word() for _ in range(n))} {passage}" for n in rng.integers(0, 90, 160)]
    texts += [t for b in range(25) for t in copies(rng, " ".join(word() for _ in range(30 + b)), 3, 1)]
    texts += [None, "", "a b", "a  B", "a b c d e", "a b c d e f", "x"]
    rows = [*enumerate(texts)]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    got = {tuple(r) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_keeps_one_of_each_group(spark, odd, empty):
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r[0] for r in kept.collect() if r[0]) == [1, 2, 3, 4, 6, 7]
    assert jaccard.keep_first(empty).count() == 0


# -- 5: HTML

def test_main_text_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><!-- ad --><div class="ad">Buy this now, it is the best of all things.</div>
    <div class="cookie-notice">We use cookies on this page.</div><form><p>Your name please</p><input></form>
    <article><h1>A   title</h1><p><b>One &amp;amp; two<br>three.<p>Four&nbsp;five.</p><p>Six.</p>
    <section id="comments"><p>I think that this is a comment of some length by a reader.</p></section></article>
    <aside><p>Also read this other story about the same subject.</p></aside><footer>&copy; 2020</footer></body></html>"""
    assert html_text.main_text(page, html_text.trained()) == "A title One &amp; two three. Four five. Six."


def test_main_text_of_article_heads_and_comment_articles():
    page = """<main><article class="post"><header class="entry-header"><h1>Head</h1></header><div class="entry-content"><p>Body text.</p></div>
    <article class="comment"><p>A reader says something long enough to look like text of the page itself.</p></article></article></main>"""
    assert html_text.main_text(page, html_text.trained()) == "Head Body text."


def test_main_text_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p", "x"), (4, "u", "<article><p>cut &am", "x"),
                                   (5, "u", "<div>" * 3000 + "<main><p>deep", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.page_texts(pages).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("", 0), 4: ("cut &am", 7), 5: ("deep", 4)}


def test_op5_reads_articles_whole(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    for r in result(spark, "op5_html").itertuples():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.n_chars == len(r.text)
        words = html_text.main_text(f"<main>{article}</main>", html_text.trained())
        assert r.text == words


WRAPPERS = ["container has-sidebar", "layout with-sidebar", "page no-ads", "content sticky-header", "page--with-sidebar", "content-sidebar-wrap",
            "page comments-open"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_main_text_in_wrappers_with_other_names(wrapper):
    page = f"""<body class="single comments-open no-sidebar"><div class="{wrapper}" aria-label="Search results and comments"><nav><a href=/>Home</a></nav>
    <article class="post tag-comments"><h1 id="search">A title</h1><p id="tags">One.</p><section id="related-work"><h2 id="related">Related work</h2>
    <p>Two.</p></section><div class="section" id="share"><p>Three.</p></div><section aria-label="Search and find"><p>Four.</p></section>
    <ol class="comment-list"><li><article class="comment" id="comment-4"><p>A reader has something of some length to say.</p></article></ol>
    <section id="comments"><article><p>Another reader has something of some length to say.</p></article></section>
    <div class="related-posts"><article><p>Another story, told here in one long sentence.</p></article></div></article>
    <div class="sidebar"><article><p>A story beside this one, told in one long sentence.</p></article></div></div></body>"""
    assert html_text.main_text(page, html_text.trained()) == "A title One. Related work Two. Three. Four."


@pytest.mark.parametrize("wrapper", ["container has-sidebar", "page no-ads", "content sticky-header"])
def test_main_text_in_wrappers_without_an_article(wrapper):
    one, two = ("A long run of words that stands in no article at all, and is the text of the page, number %d." % i for i in (1, 2))
    page = f'<div class="{wrapper}"><p id="search">{one}</p><p>{two}</p></div><div class="ad"><p>{one}</p></div>'
    assert html_text.main_text(page, html_text.trained()) == f"{one} {two}"


@pytest.mark.parametrize("wrapper", ["", *WRAPPERS])
def test_op5_equals_the_articles_of_the_given_pages(spark, wrapper):
    import html
    import re

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    pages["html"] = [t.replace("<article>", f'<div class="{wrapper}"><article>').replace("</article>", "</article></div>") for t in pages.html]
    got = {r["page_id"]: r["text"] for r in html_text.page_texts(spark.createDataFrame(pages[["page_id", "url", "html"]])).collect()}
    for i, page in zip(pages.page_id, pages.html):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        plain = re.sub(r"</?(?:b|a)\b[^>]*>", "", re.sub(r"<!--.*?-->", "", article, flags=re.S))
        assert got[i] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", plain)).split())


# -- 6: winnowing

def brute_fingerprint(hashes, w):
    kept = []
    for at in range(max(1, len(hashes) - w + 1)):
        window = hashes[at : at + w]
        place = max(i for i, h in enumerate(window) if h == min(window))
        if (window[place], at + place) not in kept:
            kept.append((window[place], at + place))
    return kept


def test_winnowing_keeps_rightmost_minima(spark):
    text = "a b a b a b a b c d e a b a b a b f g h i"
    df = winnowing.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "f")
    row = df.select(winnowing.hashes("f").alias("h"), winnowing.positions("f").alias("p")).first()
    n = len(text.split())
    from pyspark.sql import functions as F
    w = text.split()
    grams = spark.createDataFrame([(i, *w[i : i + 3]) for i in range(n - 2)], "i int, a string, b string, c string")
    hashes = [r[0] for r in grams.orderBy("i").select(F.xxhash64(F.struct("a", "b", "c")).bitwiseAND(F.lit(winnowing.HASHES))).collect()]
    assert [*zip(row["h"], row["p"])] == brute_fingerprint(hashes, winnowing.W)


def test_op6_edits_and_likeness(spark, documents):
    got = result(spark, "op6_winnowing").set_index("doc_id")
    texts = documents.sort_values("doc_id").reset_index(drop=True)
    for i, r in texts.iterrows():
        following = texts.text[(i + 1) % len(texts)]
        quarter = len(r.text) // 4
        edited = r.text[: len(r.text) - quarter] + following[:quarter]
        assert got.edited_sha256[r.doc_id] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.n_chars[r.doc_id] == len(r.text)
    prints = got.fingerprint.to_dict()
    by_text = texts.groupby("text").doc_id.apply(list)
    assert all(len({prints[i] for i in ids}) == 1 for ids in by_text)
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > got.near_next.mean() + 0.3


def test_winnowing_chunks_and_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(winnowing, "CHUNK_ROWS", 3)
    df = spark.createDataFrame([(i * 7, f"text {i}") for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in winnowing.with_next(df, "doc_id", lambda x: x).collect()}
    assert got == {i * 7: f"text {(i + 1) % 40}" for i in range(40)}
    assert winnowing.fingerprints(odd).count() == len(ODD)
    assert winnowing.fingerprints(empty).count() == 0


def unspaced_texts():
    rng = np.random.default_rng(7)
    pick = lambda letters, n: "".join(rng.choice([*letters], n))
    return [
        pick([chr(c) for c in range(0x4E00, 0x5000)], 400),
        pick([chr(c) for c in range(0x3041, 0x3097)], 20) + "".join(f" {pick([chr(c) for c in range(0x30A1, 0x30FB)], 20)}" for _ in range(8)),
        "\u00a0".join(pick("abcdefghij", 5) for _ in range(80)),
        pick("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", 500),
        pick([chr(c) for c in range(0x1F300, 0x1F600)], 200),
        pick([chr(c) for c in range(0x0E01, 0x0E30)], 300),
    ]


def test_winnowing_texts_without_blanks(spark):
    texts = unspaced_texts()
    got = winnowing.fingerprints(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).toPandas()
    assert (got.near_edited > 0.4).all() and (got.near_next < 0.1).all()


def test_winnowing_shared_passages_without_blanks(spark):
    """A run of w + k - 1 characters that two texts share leaves a hash in both."""
    texts, n = unspaced_texts(), winnowing.K + winnowing.W - 1
    rows = [(t, f"{u[:50]}{t[60 : 60 + n]}{u[50:]}") for t, u in ((texts[i], texts[i][::-1]) for i in (0, 2, 3, 4, 5))]
    rows.append(("ab 東京都千代田区 cd", "xy東京都千代田区z"))  # the same characters between other words
    df = spark.createDataFrame(rows, "a string, b string")
    df = winnowing.with_fingerprint(winnowing.with_fingerprint(df, "a", "f"), "b", "g")
    from pyspark.sql import functions as F
    common = df.select(F.size(F.array_intersect(winnowing.hashes("f"), winnowing.hashes("g"))).alias("n"))
    assert min(r["n"] for r in common.collect()) >= 1


def test_winnowing_plan_is_native(spark):
    plan = winnowing.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


# -- 7: sharding

def test_op7_shards_are_even_and_gapless(spark, documents):
    got = result(spark, "op7_sharding").merge(documents, on="doc_id")
    assert (got["size"] == [len((t or "").encode()) + 8 for t in got.text]).all()
    assert (got.text_crc32 == [zlib.crc32((t or "").encode()) for t in got.text]).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == [*range(len(part))]


def test_sharding_balances_and_splits_a_hot_group(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "same text " * 20) for i in range(3000)] + [(i, "w " * int(rng.integers(1, 400))) for i in range(3000, 9000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6, cells_per_shard=64)
    by = [r for r in sharding.balance(got).collect()]
    assert len(by) == 6 and sharding.spread_of([r["bytes"] for r in by]) < 1.03
    assert got.select("shard", "slot").distinct().count() == 9000


def test_sharding_odd_rows(odd, empty):
    got = sharding.shard(odd).collect()
    assert len(got) == len(ODD) and min(r["size"] for r in got) == 8
    assert sharding.shard(empty).count() == 0


# -- 8: decontamination

def brute_hits(text, items, window=10):
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    words, hit, names = split(text), set(), set()
    for name, body in items:
        item = split(body)
        if not item:
            continue
        size = min(window, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_op8_equals_brute_force(spark, documents):
    items = [*pd.read_parquet(f"{SF}/benchmark.parquet").itertuples(index=False, name=None)]
    got = result(spark, "op8_decontamination").set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text):
        assert tuple(got.loc[i]) == brute_hits(text, items)
    assert got.contaminated.any()


@pytest.mark.parametrize("block_words", [10**6, 5])
def test_decontamination_in_blocks(spark, block_words):
    items = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Short item"), (3, None), (4, "..."), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    texts = [None, "", "a short  ITEM b short, item", " ".join(f"w{i}" for i in range(20)), "w1 w2 w3", "short", "item short",
             "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 x w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_matches(docs, benchmark, block_words=block_words)
    got = {r["doc_id"]: r for r in found.withColumn("hit", decontaminate.covered("matches")).collect()}
    for i, text in enumerate(texts):
        n, hit, names, *_ = brute_hits(text, items)
        assert (got[i]["n_words"], got[i]["hit"], len({m["item_id"] for m in got[i]["matches"]})) == (n, hit, names)
    assert max(m["length"] for m in got[3]["matches"]) == 14


def test_decontamination_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(None, "one two three"), (1, "word " * 30)], "item_id long, text string")
    clean = decontaminate.remove_contaminated(odd, benchmark)
    assert clean.columns == odd.columns and sorted(r[0] or 0 for r in clean.collect()) == [0, 1, 2, 3, 7]
    assert decontaminate.report(empty, benchmark).count() == 0
    assert decontaminate.report(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_suffix_array_and_longest_matches():
    rng = np.random.default_rng(8)
    runs = [rng.integers(1, 4, n).tolist() for n in (40, 1, 7, 90)]
    numbers = np.array([0, *[x for r in runs for x in [*r, 0]], *[0] * 10])
    place, ends = np.flatnonzero(numbers), np.flatnonzero(numbers == 0)
    run = ends[np.searchsorted(ends, place)] - place
    suffixes = [numbers[p : p + n].tolist() for p, n in zip(place, run)]
    assert [suffixes[i] for i in decontaminate.suffix_array(numbers, place, run)] == sorted(suffixes)

    def text(n):
        return [b"abc"[i : i + 1] for i in rng.integers(0, 3, n)]

    items = [("long", text(200)), ("short", text(4)), ("middle", text(12)), (None, text(10))]
    docs = [b" ".join(x) for x in (text(300), items[0][1] + [b"z"] + items[0][1][5:150], items[2][1], text(3), [])]
    for named in (items, items[:1]):
        sizes, got = decontaminate.find(docs, decontaminate.make_block(named, 10))
        for doc, size, found in zip(docs, sizes, got):
            assert size == len(doc.split())
            assert sorted(found, key=str) == sorted(longest_matches(doc.split(), named), key=str)


def longest_matches(words, items):
    """All maximal runs that a text shares with an item: ten words or more, or all of a shorter item."""
    out = []
    for name, item in items:
        for a in range(len(words)):
            for j in range(len(item)):
                n = 0
                while a + n < len(words) and j + n < len(item) and words[a + n] == item[j + n]:
                    n += 1
                if n >= min(10, len(item)) and not (a and j and words[a - 1] == item[j - 1]):
                    out.append((name, a, j, n))
    return out


# -- 10: WARC

def test_op10_finds_every_damaged_record(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    stored = warc.stored_records(pages)
    replica = warc.damaged(stored, 5)
    digest = lambda df: {(r[0], r[1]): hashlib.sha256(bytes(r[2])).hexdigest() for r in df.select("file", "number", "record").collect()}
    a, b = digest(stored), digest(replica)
    got = warc.audit(stored, replica).collect()
    assert len(got) == pages.count()
    assert {(r["file"], r["number"]) for r in got if not r["sound"]} == {k for k in a if a[k] != b[k]} != set()
    assert warc.audit(stored, stored).where("NOT sound").count() == 0


def test_warc_missing_records_roots_and_odd_rows(spark):
    rows = [(i, f"http://a/{i}", f"<p>{i}") for i in range(60)] + [(None, None, None), (3, "http://a/3", "<p>3"), (61, "a\nb", "x" * 100_000)]
    stored = warc.stored_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    gone = stored.where("number <> 7")
    odd = warc.audit(stored, gone).where("NOT sound").collect()
    assert len(odd) >= 1 and {r["number"] for r in odd} == {7}
    assert warc.store_root(warc.tree(stored)) != warc.store_root(warc.tree(gone))
    assert stored.selectExpr("sum(length) = max(offset + length)").first()[0]
    none = warc.stored_records(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.audit(none, none).count() == 0 and warc.store_root(warc.tree(none)) is None


def test_warc_audit_starts_at_the_store_root(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}") for i in range(300)], "page_id long, url string, html string")
    stored = warc.records(pages, per_file=8).localCheckpoint()
    replica = warc.damaged(stored, 100).localCheckpoint()
    compared = []
    true_differing = warc.differing
    monkeypatch.setattr(warc, "differing", lambda a, b: compared.append((a, b)) or true_differing(a, b))
    for theirs in (stored, replica):
        compared.clear()
        bad = {tuple(r) for r in stored.select("file", "number", "record").exceptAll(theirs.select("file", "number", "record")).select("file", "number").collect()}
        assert {(r["file"], r["number"]) for r in warc.audit(stored, theirs).where("NOT sound").collect()} == bad
        assert compared[0][0].count() == compared[0][1].count() == 1
        if not bad:
            assert all(a.count() == b.count() == 0 for a, b in compared[1:])
    assert bad


# -- pipeline

def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [*pd.read_parquet(f"{SF}/benchmark.parquet").itertuples(index=False, name=None)]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).toPandas(), docs.schema)
        assert after.columns == docs.columns and after.count() <= before.count()
        if name == "near duplicates":
            groups = Counter(c for *_, c in brute_components([(r["doc_id"], r["text"]) for r in after.collect()]))
            assert max(groups.values()) == 1
        if name == "decontamination":
            kept = {r["doc_id"] for r in after.collect()}
            assert kept == {r["doc_id"] for r in before.collect() if not brute_hits(r["text"], items)[-1]}
        before = after
    assert before.count() > 0
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert ids == {r["doc_id"] for r in before.collect()}


def test_pipeline_decodes_its_ids(spark, documents):
    got = corpus_pipeline.bpe_encoding(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).toPandas().set_index("doc_id")
    library = Tokenizer.from_file(PATH)
    for i, text in zip(documents.doc_id, documents.text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got.ids[i], "<u4").tolist() == ids and got.n_tokens[i] == len(ids)
        assert got.decoded[i] == library.decode(ids, skip_special_tokens=False)
