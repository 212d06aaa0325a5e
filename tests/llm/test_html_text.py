import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text
from ledgerloom.llm.html_text import extract_text, labelled_pages, leaf_blocks, main_text, train_chain


@pytest.fixture(scope="module")
def chain():
    return train_chain(labelled_pages(250))


def test_held_out_accuracy(chain):
    hit = wrong = missed = 0
    for blocks in labelled_pages(150, seed=77):
        for b, keep in zip(blocks, chain.decode(blocks), strict=True):
            hit += keep and b.gold
            wrong += keep and not b.gold
            missed += b.gold and not keep
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now, it is cheap.</div>
<article><h1>A   title
here</h1><p><b>First &lt;bold&gt; one.<br><p>Second caf&eacute; &#x1F600; <i>in</i>line text, with more words to read.</p><script>no()</script>
<div class="advert">Another offer for you.</div><p>Third, which a<a href="x">link</a> is in, and it goes on for a while.</p></article>
<section class="comments"><h3>Comments</h3><p>I agree with all of it, really.</p></section><form><label>Mail</label><p>Subscribe to us today.</p></form>
<footer>&copy; 2024 Site &middot; All rights.</footer></body></html>"""


def test_a_page(chain):
    assert main_text(PAGE, chain) == "A title here First <bold> one. Second café 😀 inline text, with more words to read. Third, which alink is in, and it goes on for a while."


def test_broken_pages(chain):
    for html in ("<", "<p", "</p></div>", "a < b <c", "<script>x", "<!-- x", "<p>" * 3000 + "deep", "<div><p>x</div></p>y", "<a href='\">x</a>", "&#xD800;&#999999999;&bogus;", "<table><tr><td>a<td>b<tr><td>c</table>", "\0<p>\0x"):
        main_text(html, chain)
    assert [b.text for b in leaf_blocks("<table><tr><td>a<td>b<tr><td>c</table>")] == ["a", "b", "c"]
    assert [b.text for b in leaf_blocks("one<br>two<hr>three<p>four<p>five")] == ["one two", "three", "four", "five"]
    long = "<article>" + "<p>A sentence that is long enough, and ends well.</p>" * 5000 + "</article>"
    assert main_text(long, chain).count("sentence") == 5000


def test_in_spark(spark, chain):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (None, "w", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = extract_text(df, chain).collect()
    assert len(got) == 5 and {r.row["text"] for r in got} == {"own"} and sum(r.text.startswith("A title here") for r in got) == 2 and {r.text for r in got if r.row["page_id"] in (2, 3)} == {""}
    assert extract_text(df.limit(0), chain).count() == 0


@pytest.mark.parametrize("tag", ["select", "template"])
def test_an_unclosed_element_loses_only_its_tag(tag):
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts(f"<p>one<{tag} a='b'>two</p><p>three</p>") == ["one two", "three"]
    assert texts(f"<p>one<{tag}>two</p><p>three<{tag}>no</{tag}>four</p>") == ["one two", "three four"]
    assert texts(f"<p>one<{tag}>no<{tag}>no</{tag}>no<!-- <{tag}> --></{tag}>two</p><{tag}/><p>three") == ["one two", "three"]
    assert texts(f"<{tag}>" * 20_000 + "end") == ["end"]


def test_text_of_math_stays():
    assert [b.text for b in leaf_blocks("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p>and <math><mi>y</p><p>too</p>")] == ["where x=1 holds", "and y", "too"]


def test_text_of_fallbacks_stays():
    for tag in ("noscript", "object", "canvas", "svg"):
        assert " ".join(b.text for b in leaf_blocks(f"<p>one <{tag} a='b'>two</{tag}> three</p><p>four<{tag}>")) == "one two three four"


#: Pages of about a megabyte that a parser could look through again and again.
BAD = {
    "deep": "<div>a" * 160_000, "deep inline": "<b>a" * 250_000, "unclosed tags": "<a " * 330_000, "unclosed with quotes": "<a b=\"c' " * 110_000, "quotes that do not pair": "<a b=\">\" " * 110_000 + "'", "ends without starts": "<p>" * 1000 + "</b>" * 240_000,
    "far ends": "<b>" + "<div>" * 1000 + "x</b>" * 190_000, "selects": "<select " * 120_000, "open selects": "<select>" * 120_000, "scripts": "<script></script " * 60_000, "unclosed script": "<script>" + "</script" * 120_000, "comments": "<!-- " * 200_000,
    "items": "<li>a" * 200_000, "cells": "<table>" + "<td>a" * 200_000, "attributes": "<p " + "a = " * 250_000 + ">x", "open quotes": "<p " + "a='\"" * 200_000 + ">x", "less than": "<" * 1_000_000, "references": "&amp" * 250_000, "names": "<p class='" + "nav " * 250_000 + "'>x",
}


@pytest.mark.parametrize("name", BAD)
def test_time_in_proportion_to_the_page(name, chain):
    began = time.perf_counter()
    main_text(BAD[name], chain)
    assert time.perf_counter() - began < 20  # seconds; a parser that looks back takes minutes


def test_viterbi_against_enumeration(chain):
    (s0, s1), t = chain.start.tolist(), chain.transitions
    for blocks in [p[k : k + 9] for p in labelled_pages(25, seed=31) for k in (0, 4)]:
        if not blocks:
            continue
        e = chain.emissions(blocks)

        def score(path):
            return (s1 if path[0] else s0) + sum(t[a, b] for a, b in itertools.pairwise(path)) + sum(x for x, y in zip(e, path, strict=True) if y)  # noqa: B023

        best = max(score(p) for p in itertools.product((0, 1), repeat=len(blocks)))
        assert score([int(x) for x in chain.decode(blocks)]) == pytest.approx(best)


def test_gradient_against_differences():
    pages = [p for p in labelled_pages(6, seed=3) if len(p) > 2]
    data = html_text.training_data(pages)
    rng = np.random.default_rng(2)
    w, t, s = rng.normal(size=(len(data.index), 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    _, grads = html_text.loss_and_gradients(data, w, t, s, decay=0.01)
    for value, grad in zip((w, t, s), grads, strict=True):
        for _ in range(8):
            at = tuple(rng.integers(n) for n in value.shape)
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up = html_text.loss_and_gradients(data, w, t, s, decay=0.01)[0]
            value[at] = kept - step
            down = html_text.loss_and_gradients(data, w, t, s, decay=0.01)[0]
            value[at] = kept
            assert grad[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)


#: Pages written by hand, none by PageMaker, with their main text.
BY_HAND = [
    (
        """<html><body><div id="wrap"><div class="site-header"><img src="l.png" alt="x"> The Valley Courier <ul class="mainnav"><li><a href="/">Front page</a></li><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li></ul></div>
<div class="story-body"><h1>Bridge reopens after a long winter</h1><p class="byline">By our reporter, 4 March</p><p>The old stone bridge over the river was opened again on Tuesday, after five months of repairs.</p>
<p>Engineers had found cracks in two of its arches. &ldquo;It was high time,&rdquo; said the mayor, who crossed first.</p><div class="advertisement">Tyres at half price, only this week!</div><p>Traffic is limited to one lane until the end of the month.</p></div>
<div class="sidebar"><h3>Most read</h3><ol><li><a href="/a">School roof leaks</a></li><li><a href="/b">Choir wins prize</a></li></ol></div><div id="footer">&copy; Valley Courier. All rights reserved.</div></div></body></html>""",
        ["Bridge reopens after a long winter", "opened again on Tuesday, after five months of repairs.", "“It was high time,” said the mayor, who crossed first.", "Traffic is limited to one lane"],
        ["Front page", "Tyres", "School roof", "All rights"],
    ),
    (
        """<!doctype html><title>Bread</title><body><header><nav><a href=/>Home</a> <a href=/r>Recipes</a> <a href=/c>Contact</a></nav></header><main><article><h2>A plain loaf</h2><p>Mix the flour, the water and the salt, and leave the dough to rest for an hour.
<ul><li>500 g of flour</li><li>350 g of water</li><li>10 g of salt</li></ul><p>Fold it four times, shape it, and bake it in a hot pot for forty minutes.<blockquote>Good bread needs time more than anything else.</blockquote></article>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>Mine came out flat, what did I do wrong?</p></div><div class="comment"><p>Let it rest for longer, I would say.</p></div></section></main><aside class="related"><a href=/x>Rye bread</a><a href=/y>Rolls</a></aside><footer>Made with flour. <a href=/imprint>Imprint</a></footer>""",
        ["A plain loaf", "Mix the flour, the water and the salt, and leave the dough to rest for an hour.", "350 g of water", "bake it in a hot pot for forty minutes.", "Good bread needs time"],
        ["Recipes", "Mine came out flat", "Rye bread", "Imprint"],
    ),
    (
        """<body><div class="cookie-consent"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class="topbar"><a href="/">Blog</a> | <a href="/about">About</a></div><div class="post"><h1 class="post-title">Notes on a small garden</h1><div class="entry-content">
<p>I planted the beans too early this year, and the frost took half of them.</p><p>The rest grew well, and by July there were more than we could eat, so the neighbours had their share.</p><noscript></noscript><figure><img src="b.jpg"><figcaption>The beans in June, before the storm.</figcaption></figure><p>Next spring I shall wait.</p></div>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></div><div id="respond"><h3>Leave a reply</h3><form><label>Your name</label><input><p>Your address will not be published.</p></form></div><div class="footer"><p>Powered by nothing in particular.</p></div></body>""",
        ["Notes on a small garden", "the frost took half of them.", "so the neighbours had their share.", "Next spring I shall wait."],
        ["cookies", "About", "Tweet", "Leave a reply", "Powered by"],
    ),
]


def test_pages_written_by_hand(chain):
    hit = total = 0
    for html, wanted, unwanted in BY_HAND:
        text = main_text(html, chain)
        hit += sum(w in text for w in wanted) + sum(u not in text for u in unwanted)
        total += len(wanted) + len(unwanted)
    assert hit / total >= 0.95
