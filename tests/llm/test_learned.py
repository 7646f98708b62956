"""Quality, toxicity, main text, and the pipeline."""

import functools
import html
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_near
from quillstone.llm import bpe, html_extract, quality, toxicity, util
from quillstone.llm.queries import QUERIES, VOCABULARY
from quillstone.llm.util import crc_fold, crc_fold_py, labelled_sample, lowest

DATA = "/root/testdata/sf0.01"


def test_folds(spark):
    rows = spark.range(50).select("id", crc_fold("id", 4).alias("f")).collect()
    assert all(r.f == crc_fold_py(r.id, 4) == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


def test_sample_is_bounded_and_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = {r.doc_id for r in labels.collect() if crc_fold_py(r.doc_id, 4) != 2}
    texts = {r.text for r in docs.collect() if r.doc_id in known}
    sample = labelled_sample(docs, labels, "toxic", 4, 2, 10)
    assert sum(y for _, y in sample) <= 10 and len(sample) <= 20 and {t for t, _ in sample} <= texts
    assert sample == labelled_sample(docs.repartition(5), labels.repartition(3), "toxic", 4, 2, 10)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 7, 7)], "doc_id long, quality int, toxic int")
    assert labelled_sample(docs, odd, "toxic", 4, 2, 10) == []


def test_repeated_labels_do_not_crowd_out_others(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(400)]
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    sample = labelled_sample(docs, labels(rows), "toxic", 4, 2, 10)
    assert [sum(y == c for _, y in sample) for c in (0, 1)] == [10, 10]
    assert sample == labelled_sample(docs, labels(rows + [rows[int(sample[0][0][5:])]] * 500), "toxic", 4, 2, 10)


def test_a_share_of_hashes(spark):
    """Of many rows, a bit more than the limit pass; of few, all."""
    ids = spark.range(20000)
    assert 1800 < ids.where(lowest(F.xxhash64("id"), 0.1)).count() < 2200
    assert ids.where(lowest(F.xxhash64("id"), 1.0)).count() == ids.where(lowest(F.xxhash64("id"), 7.0)).count() == 20000
    assert ids.where(lowest(F.xxhash64("id"), 1e-12)).count() == 0


def test_sample_leaves_out_only_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr(util, "SAMPLE_CHARS", 100)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    kept = [i for i in range(20) if crc_fold_py(i, 4) != 2]
    ones, zeros = [i for i in kept if i % 2], [i for i in kept if i % 2 == 0]
    sample = lambda rows, size=100: labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 4, 2, size)
    for giant in ones:  # whichever comes first in the order
        rows = [(i, "x" * 101 if i == giant else f"text {i}") for i in kept]
        assert sorted(sample(rows)) == sorted((f"text {i}", i % 2) for i in kept if i != giant)
    # many rows of one id count once; many texts of one id leave the others in
    rows = [(i, f"text {i}") for i in kept]
    assert sorted(sample(rows + [(ones[0], f"text {ones[0]}")] * 50 + [(ones[1], None)] * 50)) == sorted([*((f"text {i}", i % 2) for i in kept), ("", 1)])
    got = sample(rows + [(i, f"{k:08}") for i in ones for k in range(30)])
    assert {t for t, y in got if y == 0} == {f"text {i}" for i in zeros} and 92 < sum(len(t) for t, y in got if y) <= 100
    with pytest.raises(ValueError, match="toxic = 1"):
        sample([(i, "x" * 101 if i % 2 else "y") for i in kept])


# -- toxicity


def noisy(n=1200, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["grubble", "snarkle", "foulness"], k=rng.randint(1, 4))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_texts():
    rows = noisy()
    model = toxicity.fit(rows[:800], 0.25)
    score = lambda t: model.probability(model.excess(model.segments(model.scores(t.split())), len(t.split())))
    wrong = [(t, y) for t, y in rows[800:] if (score(t) >= toxicity.THRESHOLD) != bool(y)]
    assert len(wrong) <= 4
    assert all(u in ("grubble", "snarkle", "foulness") or u.endswith("*") for u, s in model.units.items() if s > 0)


def test_passages_are_where_the_words_are(spark):
    model = toxicity.fit(noisy(), 0.25)
    text = " ".join(["word1"] * 30 + ["grubble", "snarkle"] + ["word2"] * 200 + ["foulness"] + ["word3"] * 10)
    r = toxicity.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.predicted == 1 and [(p.start, p.end) for p in r.passages] == [(30, 32), (232, 233)]


def test_weak_words_count_once():
    model = toxicity.Model({"maybe": 1.0, "surely": 5.0, "pre*": 1.0}, {"maybe", "pre*"})
    assert model.scores(["maybe", "x", "maybe!", "maybe", "surely", "surely"]) == [1.0, 0.0, 1.0, 0.0, 5.0, 5.0]
    assert model.unit("prefix") is None and model.unit("maybe") == "maybe"


def brute_segments(scores):
    """All maximal scoring segments by repeated best subsequence, longest sum first."""
    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 1e-12:
            out.append((best[3], best[4], best[0]))
            todo += [(a, best[3]), (best[4], b)]
    return sorted(out)


def test_segments_against_brute_force():
    rng = random.Random(4)
    model = toxicity.Model()
    for _ in range(200):
        scores = [rng.choice([0.0, 0.0, 0.0, 0.317, 0.733, 2.011]) for _ in range(rng.randint(1, 25))]
        got = sorted(model.segments(scores))
        want = brute_segments([s - toxicity.DRIFT for s in scores])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_segments_take_linear_time():
    rng = random.Random(1)
    model = toxicity.Model()
    for values in ([0.0, 0.0, 0.4, 2.0], [0.06, 0.0, 0.051], [0.0, 0.2]):
        scores = rng.choices(values, k=160_000)
        began = time.time()
        assert model.segments(scores)
        assert time.time() - began < 2
    began = time.time()  # sums that fall all the way: every candidate stays
    assert len(model.segments([0.051, 0.0, 0.0] * 50_000)) == 50_000 and time.time() - began < 2


def test_near_copies_count_once():
    base = [f"t{i}" for i in range(60)]
    copies = [(" ".join([*base[:k], "changed", *base[k + 1 :]]), 1) for k in range(20)]
    assert len(toxicity.distinct(copies + [("something else entirely here", 0)])) < 8


def test_toxicity_query(spark):
    rows = QUERIES["op10_toxicity"](spark, DATA).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (crc_fold_py(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:  # again from the model's numbers, with the segments of the brute-force scan where there are few hot words
        words = (texts[r.doc_id] or "").lower().split()
        found = model.scores(words)
        hot = [k for k, s in enumerate(found) if s]
        segs = brute_segments([s - toxicity.DRIFT for s in found[hot[0] : hot[-1] + 1]]) if hot and hot[-1] - hot[0] < 25 else model.segments(found)
        over = [model.lam * s - math.log(model.k * max(1, len(words))) for *_, s in segs]
        x = sum(v for v in over if v > 0) or max(over, default=-math.log(model.k * max(1, len(words))) - 1)
        assert abs(r.score - 1 / (1 + math.exp(-(model.slope * max(-50, min(50, x)) + model.offset)))) < 1e-9
        assert r.n_passages == sum(model.k * len(words) * math.exp(-model.lam * s) < toxicity.E_VALUE for *_, s in segs)
    clean = [r.predicted for r in rows if labels.get(r.doc_id) == 0]
    toxic = [r.predicted for r in rows if labels.get(r.doc_id) == 1]
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.6 * len(toxic)  # the table has few toxic labels


# -- quality


def test_quality_on_held_out_texts(spark):
    rows = QUERIES["op7_quality"](spark, DATA).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts, of = {r.doc_id: r.text for r in docs.collect()}, functools.cache(model.piece)
    for r in rows:  # again from the model's numbers
        parts = quality.pieces(texts[r.doc_id])
        assert abs(r.score - 1 / (1 + math.exp(-sum(map(of, parts)) / max(1, len(parts)) - model.offset))) < 1e-6
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(r.held_out == (crc_fold_py(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_scoring_is_the_models(spark):
    model = quality.fit([("good words here to read to read " + "good good " * (i % 3) + str(i), 1) for i in range(60)] + [("BAD!! BAD!! WORSE!! " * 3 + str(i), 0) for i in range(60)])
    df = spark.createDataFrame([(1, "good words here here to read"), (2, "BAD!! WORSE!!"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    import math

    for i, text in ((1, "good words here here to read"), (2, "BAD!! WORSE!!")):
        parts = quality.pieces(text)
        mean = sum(model.piece(p) for p in parts) / len(parts)
        assert abs(got[i].score - 1 / (1 + math.exp(-mean - model.offset))) < 1e-6
    assert got[1].predicted == 1 and got[2].predicted == 0 and 0 < got[3].score < 1
    assert quality.pieces("a a b") == ["a", "a", quality.REPEATED, "b"]


@pytest.mark.parametrize("slab", [1 << 16, 7])
def test_long_pieces_count_whole(spark, monkeypatch, slab):
    monkeypatch.setattr(quality, "SLAB", slab)
    rng = random.Random(3)
    for letters in ("ab", "aéß", "文章質", "a文😀é\udc80"):
        for n in (81, 90, 300):
            piece = "".join(rng.choices(letters, k=n))
            assert sorted(x for ids in quality.long_buckets(piece) for x in ids) == sorted(quality.buckets(piece))
            assert len(quality.buckets(piece)) == 1 + 3 * n  # n + 1, n and n - 1 n-grams of two, three and four characters


def test_training_sees_all_of_a_long_document():
    rng = random.Random(7)
    filler = lambda n: rng.choices([f"w{k}" for k in range(300)], k=n)
    text = lambda word, at: " ".join([*filler(at), *[word] * 700, *filler(2100 - at)])
    for at in (0, 1050, 2100):  # wherever in the text the telling part is
        model = quality.fit([(text("fine" if y else "poor", at), y) for y in (0, 1) for _ in range(30)])
        others = [abs(model.piece(f"w{k}")) for k in range(300)]
        assert model.piece("fine") > 2 * max(others) and -model.piece("poor") > 2 * max(others)


def test_documents_that_differ_in_the_middle(spark, monkeypatch):
    ends = "文" * 40
    text = lambda i, letters: ends + "".join(random.Random(i).choices(letters, k=400)) + ends
    sample = [(text(i, "良好質量"), 1) for i in range(60)] + [(text(i, "壞垃圾差"), 0) for i in range(60)]
    model = quality.fit(sample)
    df = spark.createDataFrame([(1, text(901, "良好質量")), (2, text(902, "壞垃圾差"))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0
    for i, letters in ((1, "良好質量"), (2, "壞垃圾差")):
        assert abs(got[i].score - 1 / (1 + math.exp(-model.piece(text(900 + i, letters)) - model.offset))) < 1e-6
    monkeypatch.setattr(quality, "MANY", 10)  # by bucket first: the same up to rounding
    assert np.allclose(quality.fit(sample).weights, model.weights, atol=1e-4)


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_without_labels(spark, awkward, operator):
    docs = awkward.select("doc_id", "text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    if operator == "toxicity":
        out = toxicity.detect(awkward, toxicity.train(docs, labels))
    else:
        out = quality.score(awkward, quality.train(docs, labels))
    rows = out.collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)  # the clashing columns are replaced
    assert out.where("doc_id = 1").select("score").distinct().count() == 1
    assert (toxicity.detect(awkward.limit(0), toxicity.Model()) if operator == "toxicity" else out.limit(0)).count() == 0


# -- main text


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [re.search(r"<h1>(.*?)</h1>", inner, re.S)[1], *re.findall(r"<p>(?:<b>)?(.*?)(?:</p>|<br>)", inner[inner.index("</h1>") :], re.S)]
    return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in parts) if x)


def test_pages_give_their_articles(spark):
    got = {r.page_id: r for r in QUERIES["op3_html"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article(p.html)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_the_ratios_decide(spark, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    right = lambda some: sum(html_extract.main_text(p) == article(q) for p, q in zip(some, pages))
    assert right(plain) == len(pages)  # no tag tells the article there
    rng = np.random.default_rng(0)

    def any_ratios(found):
        of = {}
        return np.array([of.setdefault(e.path, rng.random()) for *_, e in found])

    monkeypatch.setattr(html_extract, "ratios", any_ratios)
    assert right(plain) < 0.7 * len(pages) and right(pages) < 0.97 * len(pages)
    monkeypatch.setattr(html_extract, "ratios", lambda found: np.ones(len(found)))
    assert right(plain) == 0


LONG = "A sentence of prose, with commas; and more of it. " * 6
SECTIONS = f"""<article><h1>Title</h1><p>{LONG}</p><section class="share-of-market"><h2>Shares</h2><p>{LONG}</p></section>
<section id="search-algorithms"><h2>Search</h2><p>Short, here.</p></section><div class="feedback-loops no-banner"><p>{LONG}</p><ul><li>x</li><li>y</li></ul></div>
<div class="share">Share, now.</div><div class="post-comments"><p>{LONG}</p></div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p><a href=3>The source of it</a></p></article>"""


@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_inside_an_article(tag):
    page = f"<body><div class=menu>Menu, here.</div>{SECTIONS.replace('article', tag)}<div class='newsletter-signup'><p>{LONG}</p></div></body>"
    one = LONG.strip()
    assert html_extract.main_text(page) == f"Title\n{one}\nShares\n{one}\nSearch\nShort, here.\n{one}\nx\ny\nThe source of it"


def test_boilerplate_at_any_depth():
    deep = lambda inner: "<div>" * 300 + inner + "</div>" * 300
    inner = f"<nav><ul><li>Menu, entry.</ul></nav><p>{LONG}</p><div class=comments><p>{LONG} Comment.</p></div><aside><p>{LONG}</p></aside>"
    assert html_extract.main_text(f"<body>{deep(inner)}</body>") == LONG.strip()
    assert html_extract.main_text(f"<body><article>{deep(inner)}</article></body>") == LONG.strip()


def test_reading_takes_linear_time():
    pages = [
        "<a " * 350_000, "<a href='x" * 100_000, "<![CDATA[" * 100_000 + ">", "</script " * 100_000, "<div>" * 20_000 + "x<li>y" * 5000, "<dl>" * 5000 + "<li>z" * 5000,
        "<b>" * 20_000 + "<p>t</b>" * 5000, "<p>x<a " * 50_000 + ">", "<div><p>some, text." * 10_000, "<td>x" * 20_000, "</b>" * 100_000, "<!--" * 100_000, "<? " * 100_000,
    ]
    for page in pages:
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 3, page[:20]


PAGE = """<html><head><title>T</title><script>var a = "<p>x</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<div class="cookie-notice">We use cookies. Accept, please.</div><div id="wrap"><div class="sidebar"><ul><li><a href=1>x</a></ul></div><div class="post">
<h2>Head &lt;one&gt;</h2><p>First paragraph, with   text; and&nbsp;more. Indeed.</p><p>Short.</p><ul><li>item one<li>item two</ul><blockquote>Quote, here.</blockquote>
<p>Last paragraph, a long one with words.</p></div><section class="comments"><p>Nice post, thanks! Really great, I think, and so on.</p></section></div>
<form><p>Subscribe now</p></form><footer>c</footer></body></html>"""


def test_page_without_article():
    assert html_extract.main_text(PAGE) == (
        "Head <one>\nFirst paragraph, with text; and more. Indeed.\nShort.\nitem one\nitem two\nQuote, here.\nLast paragraph, a long one with words."
    )


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b", "a\nb"),
        ("<script>x", ""),
        ("<main><article><header><h1>T</h1></header><p>One <script>x('</p>')</script>two<br>three.</p><aside>side</aside><div class=comments><article class=comment>no</article></div></article></main>", "T\nOne two three."),
        ("<article><p>a < b &#169; &unknown; &#x1F600;</p></article>", "a < b © &unknown; 😀"),
        ('<div hidden>no</div><p style="display: none">no</p><p>yes</p>', "yes"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
        ("<p title='a>b'>x</p>", "x"),
        ("<article><p>One, two.</p></article><article><p>Three, four.</p></article><article class='comment'><p>no</p></article>", "One, two.\nThree, four."),
    ],
)
def test_small_pages(page, text):
    assert html_extract.main_text(page) == text


def test_all_of_an_article_in_a_div():
    long = [f"Part {i}, " + "some words, and more. " * 18 for i in range(8)]
    parts = [("address", "By Someone"), ("h1", "Title"), *[("p", x.strip()) for x in long], ("h2", "See also"), *[("li", f"a short item of the list no {i}") for i in range(3)], ("li", "<a href=x>All of it a link</a>")]
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
    page = f"<body><div><span>Site</span></div><div class=wrap><div class=menu><ul><li><a href=1>x</a></ul></div><div class=post>{inner}<div class=share>Share, now.</div></div></div><div>End</div></body>"
    want = "\n".join("All of it a link" if "href" in x else x for _, x in parts)
    assert html_extract.main_text(page) == want
    one = f"<body><div class=post><h2>Title</h2><p>Short.</p><p>{long[0]}</p><p>End</p></div></body>"
    assert html_extract.main_text(one) == f"Title\nShort.\n{long[0].strip()}\nEnd"


def test_end_tags_of_deep_elements():
    nested = "<div>" * 400 + "<ul><li>x, y.<li>z</ul>" + "</div>" * 400
    assert html_extract.main_text(f"<div><div class=sidebar>{nested}<p>Still aside, here.</p></div><p>yes</p></div>") == "yes"


def test_deep_and_broken_pages():
    assert html_extract.main_text("<div>" * 20000 + "text, here." + "</div>" * 20000) == "text, here."
    assert html_extract.main_text("<p " * 3000) is not None and html_extract.main_text("<a href='x" * 500) is not None
    assert html_extract.main_text("<article><p>" + "word, " * 200000 + "</p></article>") == ("word, " * 200000).strip()


def test_extract_awkward_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None)], "page_id long, url string, html string, n_chars long")
    rows = html_extract.extract(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in rows) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


# -- the pipeline


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1.5)).withColumn("Toxic", F.lit("x")).withColumn("good", F.lit(0)).withColumn("gone", F.col("doc_id"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "packing"]
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 3:
            assert out.columns == docs.columns and out.where("score <> 1.5 or Toxic <> 'x' or good <> 0 or gone <> doc_id").count() == 0
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            after = docs.count()
            assert 0.8 * before < after < before
            before = after
        else:
            assert out.select("doc_id").distinct().count() == before
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id").count() <= 2


def test_stages_on_awkward_tables(spark, awkward, tmp_path):
    for name, table in (("some", awkward), ("none", awkward.limit(0))):
        docs = table.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)


def test_run_against_brute_force(spark):
    """Every stage by hand on what the one before kept: models' scores, components of all pairs, the library's ids."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    left = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.train(docs, labels)

    def toxic(text):
        words = text.lower().split()
        return model.probability(model.excess(model.segments(model.scores(words)), len(words))) >= toxicity.THRESHOLD

    left = {i: t for i, t in left.items() if not toxic(t)}
    good = quality.train(spark.createDataFrame(list(left.items()), docs.schema), labels)
    of = functools.cache(good.piece)
    mean = lambda parts: sum(map(of, parts)) / max(1, len(parts))
    left = {i: t for i, t in left.items() if mean(quality.pieces(t)) + good.offset >= 0}
    ids = sorted(left)
    root = test_near.linked(len(ids), test_near.brute([left[i] for i in ids]))
    left = {i: left[i] for k, i in enumerate(ids) if root[k] == k}
    rows = corpus_pipeline.run(spark, DATA).collect()
    codec, pieces, sequences = bpe.codec(VOCABULARY), {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == left.keys() and len(left) < len(ids)
    for i, text in left.items():
        whole = np.array([*codec.library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) // 4 and r.ids_crc32 == zlib.crc32(whole[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(whole) // 4
    for parts in sequences.values():
        n = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == n
            n += r.length
        assert n == parts[0].sequence_tokens <= 2048 and n & (n - 1) == 0  # no padding
