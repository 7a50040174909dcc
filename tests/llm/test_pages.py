"""Main text of pages: built pages, broken ones and the whole small table."""

import html
import re

import numpy as np
import pytest

from colloquy.llm import queries
from colloquy.llm.pages import extract_pages, main_text, smoothed, threshold

LONG = "A paragraph of the text with several words to read, so that it counts as content of the page."
SIDES = [
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>",
    "<header><h2>The site</h2><p>Its slogan, which is rather long for a slogan of a site.</p></header>",
    "<footer>&copy; 2020 a firm with a long name and an address</footer>",
    f"<aside><p>{LONG}</p></aside>",
    f"<div class='site-sidebar'><p>{LONG}</p></div>",
    f"<div id='cookieNotice'><p>{LONG}</p></div>",
    f"<div class='ad'>{LONG}</div>",
    f"<form action='/x'><p>{LONG}</p><input name='q'><button>Send</button></form>",
    "<script>if (a < b) document.write('<p>no</p>')</script>",
    "<style>p > b {margin: 0}</style>",
    f"<section class='comments'><h3>Comments</h3><article class='comment'><p>{LONG}</p></article></section>",
    "<div class='x7'><ul><li><a href='1'>Read this one next</a></li><li><a href='2'>And that one too</a></li></ul></div>",
    f"<!-- {LONG} -->",
    f"<div role='complementary'><p>{LONG}</p></div>",
]


@pytest.mark.parametrize("side", SIDES)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div class='post-body'>{}</div>", "<div>{}</div>"])
def test_only_the_article_stays(side, frame):
    body = f"<h1>Title</h1><p>{LONG} One &amp; &eacute;.</p><p>Short.<p>{LONG}\n two\t <b>bold</b> x<br>y</p>"
    want = f"Title\n\n{LONG} One & é.\n\nShort.\n\n{LONG} two bold x y"
    for page in (f"<html><head><title>T</title></head><body>{side}{frame.format(body)}</body></html>", f"<body>{frame.format(body)}{side}", f"<div class='page no-sidebar'>{side}<div>{frame.format(body)}</div></div>"):
        assert main_text(page) == want, page


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("plain  text", "plain text"), ("<p>one", "one"), ("<p>a<p>b", "a\n\nb"), ("<article><p>Hi</article><div class=ad>" + LONG * 3 + "</div>", "Hi"),
    ("<nav><a>x</a><article><h1>T</h1><p>text</article>", "T\n\ntext"), ("<article><p>open <b>bold<p>next</article>", "open bold\n\nnext"), ("<p>&lt;p&gt; &#x41; &eacute &am", "<p> A é &am"),
    ("<p>a</span></div> b</p>", "a b"), ("<form><article><p>inside a form</p></article></form>", "inside a form"), ("<article><ul><li>one<li>two</ul></article>", "one\n\ntwo"),
])
def test_small_and_broken_pages(page, want):
    assert main_text(page) == want


def test_deep_and_long_pages_end():
    assert main_text("<div>" * 3000 + f"<p>{LONG}") == LONG
    assert main_text(f"<article>{'<p>word' * 20_000}</article>").count("word") == 20_000


def test_threshold_splits_two_clusters():
    assert 1 < threshold(np.array([0.1, 5.0, 0.2, 1.0, 4.0])) <= 2.5 and threshold(np.array([2.0, 2.0])) == 2.0 and threshold(np.array([3.0])) == 3.0
    flat = smoothed(np.ones(9))
    assert np.allclose(flat, 1)
    assert smoothed(np.array([0.0, 0, 9, 0, 0])).argmax() == 2


def test_query_on_whole_table(spark):
    """The table's pages have one article each, with paragraphs and line breaks."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op11_text_ratio_pages(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "u", "<p>x</p>", "t", 9), (1, "u", "<p>x</p>", "t", 9), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, extract_pages(pages).collect()), key=str) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert extract_pages(pages.filter("false")).count() == 0
