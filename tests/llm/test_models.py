import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import odd_documents
from veritab.llm import op5_toxicity as op5
from veritab.llm import op9_html as op9
from veritab.llm.common import ship
from veritab.llm.labelled_pages import labelled_pages
from veritab.llm.op3_quality import quality_scores, statistics
from veritab.llm.op5_toxicity import toxicity_scores
from veritab.llm.scoring import isotonic

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@given
@pytest.mark.parametrize("score, label, modulus, held", [(quality_scores, "quality", 4, 2), (toxicity_scores, "toxic", 3, 1)])
def test_held_out_rows_are_right_and_not_learned_from(spark, score, label, modulus, held):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    truth = {r.doc_id: r[label] for r in labels.collect()}
    judged = [got[d].predicted == y for d, y in truth.items() if got[d].held_out]
    assert len(judged) > 60 and np.mean(judged) > 0.95
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    turned = labels.withColumn(label, F.when(remainder == held, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in score(docs, turned).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in got.items())


def test_scores_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    for score in (quality_scores, toxicity_scores):
        for known in (labels, labels.filter("false")):
            rows = score(docs, known).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            assert all(r.held_out for r in rows if r.doc_id is None)
        assert score(docs.filter("false"), labels).count() == 0


def test_lexicon_is_learned_from_small_slices(spark, monkeypatch):
    """What is counted at once doesn't follow the size of Arrow batches, and nothing is left out."""
    made = op5.units

    def small(data, starts):
        assert len(data) <= 1.1 * (1 << 20)
        return made(data, starts)

    monkeypatch.setattr(op5, "units", small)
    ship(spark)
    train = spark.range(0, 1000, 1, 1).selectExpr("repeat(if(id % 10 = 0, 'vile words ', 'some words '), 400) AS text", "int(id % 10 = 0) AS y")
    lexicon = op5.learn_lexicon(train)
    assert sorted(lexicon.found) == sorted(made(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))[2][0])


def test_units_are_counted_once_a_text():
    rng = np.random.default_rng(3)
    for n in [0, 1, *rng.integers(2, 60, 50)]:
        hashed, doc, y = rng.integers(0, 9, n).astype(np.uint64), np.sort(rng.integers(0, 7, n)), rng.integers(0, 2, 7)
        both = sorted({(int(u), int(d)) for u, d in zip(hashed, doc, strict=True) if u})
        expected = [(u, len(own), sum(int(y[d]) for _, d in own)) for u, own in ((u, list(own)) for u, own in itertools.groupby(both, lambda x: x[0]))]
        assert [*zip(*(c.tolist() for c in op5.rows_of_units(hashed, doc, y)), strict=True)] == expected


def test_statistics_see_whole_texts():
    plain, spoilt = "word " * 5000, "word " * 4000 + "WORD!! " * 1000
    a, b, none = statistics(pa.array([plain, spoilt, None]))
    assert not np.allclose(a, b) and np.allclose(none, 0)


def test_isotonic_rates_never_fall():
    rng = np.random.default_rng(0)
    total = rng.integers(0, 5, 60).astype(float)
    rates = isotonic(total, np.minimum(total, rng.integers(0, 5, 60)))
    assert len(rates) == 60 and (np.diff(rates) >= -1e-12).all() and rates.min() >= 0 and rates.max() <= 1


# --- pages ---
def test_marginals_are_those_of_all_labellings():
    model = op9.model()
    for page in ("<div>a b.<p>text one two three four five six.</p></div>", "<nav><a href=x>k</a></nav><article><p>x</p></article>", "<p>a<p>b"):
        nodes = op9.parse(page)
        assert len(nodes) < 12
        total, content = 0.0, np.zeros(len(nodes))
        for states in itertools.product((0, 1), repeat=len(nodes)):
            weight = model.root[states[0]]
            for k, node in enumerate(nodes):
                if k:
                    weight *= model.move(node.kind, states[node.parent])[states[k]]
                for sign in op9.shown(node):
                    weight *= model.signs[sign][states[k]]
            total += weight
            content += weight * np.array(states)
        assert np.allclose(model.marginals(nodes)[1:], (content / total)[1:])


def test_labelled_pages_not_trained_on():
    model, wrong, n = op9.model(), 0, 0
    for page in labelled_pages(3, seed=77):
        nodes, states = op9.parse(page), []
        for node in nodes:
            states.append(node.label if node.label is not None else states[node.parent] if node.parent >= 0 else 0)
        for node, state, p in zip(nodes, states, model.marginals(nodes), strict=True):
            if node.text:
                n, wrong = n + 1, wrong + ((p > 0.5) != state)
    assert n > 300 and wrong / n < 0.02


def test_main_text():
    text = op9.model().text
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name here</header>'
            '<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-banner">We use cookies.</div>'
            "<article><h1>A &amp; B&nbsp;C</h1><p>One\n <b>two</b>\tthree.<br>four<p>Five &lt;six&gt; &#228;.</p><div class='ad'>Buy now, it is cheap today.</div>"
            '<p>Seven.</p><form><p>Your mail</p><input></form></article><section id="comments"><div class="comment"><p>Great article, thanks a lot.</p></div></section>'
            '<aside><p>More of this kind.</p></aside><footer>&copy; us</footer></body></html>')
    assert text(page) == "A & B C\nOne two three. four\nFive <six> ä.\nSeven."
    assert text(page[: page.index("Seven") + 5]) == "A & B C\nOne two three. four\nFive <six> ä.\nSeven"
    assert [text(x) for x in ("", None, "<p", "<", "</div></div>", "<script>x")] == [""] * 6


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", "<article><p>Text of it.</p></article>"), (1, None, None), (None, "u", ""), (2, "u", "<div>" * 3000 + "deep"), (3, "u", "<article>" + "<p>x</p>" * 20000)]
    got = op9.main_text(spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert got[4].text == "\n".join("x" * 20000)


@given
def test_articles_of_the_given_pages(spark):
    """Pages there have one article element; its blocks, read off by patterns, are the main text."""
    import html
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>", "\0", inner.replace("<br>", " ")))
        return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in inner.split("\0")) if x)

    truth = {r.page_id: article(r.html) for r in read(spark, "pages").collect()}
    assert {r.page_id: r.text for r in op9.main_text(read(spark, "pages")).collect()} == truth


def test_unclosed_unseen_elements_end_with_their_block():
    def shown(page):
        return [n.text for n in op9.parse(page) if n.text is not None]

    for tag in ("button", "select", "svg", "object", "canvas", "audio", "video"):
        assert shown(f"<body><div>a<{tag}>no</div><p>b</p>") == ["a", "b"]
        assert shown(f"<body><div>a<{tag}>no</{tag}> b</div><p>c") == ["a b", "c"]
    assert shown("<head><title>t</title><meta name=x><p>a</p><p>b") == ["a", "b"]
    assert shown("<head><script>x</script>a<p>b") == ["a", "b"]
    assert shown("<head><title>t</title></head><body><p>a") == ["a"]
    assert shown("<p>a<button><p>no</p></button></p><p>b") == ["a", "b"]
    assert shown("<p>a<svg><path><p>b") == ["a", "b"]
    assert shown("<svg><foreignObject><div>no</div></foreignObject></svg><p>a") == ["a"]
    assert shown("<p>a <math><mi>x</mi><annotation>no</annotation></math> b</p>") == ["a x b"]
