"""Operator 12: blocks, tree and main text of made and given pages."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import extract

LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
PAGES = {
    f"<header><h1>Site</h1><p>{LONG}</p></header><nav><a href=x>Home</a></nav><article><header><h1>T</h1></header><p>{LONG}</p><aside>Side note of some length beside it</aside><p>Short.</p><form><label>Mail</label><input></form><section class='comments'><h2>Comments</h2><article class=comment><p>{LONG}</p></article></section></article><footer>c</footer>": ["T", LONG, "Short."],
    f"<div id=header>Site</div><div id=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=content><h2>Title here</h2><p>{LONG}</p><p>Ok.</p><div class='ad-banner'>Buy now {LONG}</div><p>{LONG}</p></div><div class=sidebar>{LONG}</div><div id='comments'><p>{LONG}</p></div><div class=footer>foot</div>": ["Title here", LONG, "Ok.", LONG],
    f"<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><h1>Title words here</h1><p>{LONG}</p><p>{LONG} <a href=z>link</a></p><p>{LONG}</p><p><a href=1>next</a> <a>prev</a></p><p>(c) 2020</p>": ["Title words here", LONG, LONG + " link", LONG],
    f"<div class='cookie-notice'>We use cookies {LONG}</div><main><h1>Ti</h1><p>{LONG}</p><ul><li>a b</li><li>c d</li></ul></main><aside>{LONG}</aside>": ["Ti", LONG, "a b", "c d"],
    f"<article><p title='a>b'>{LONG}</p><p title='it's bad>{LONG}</p><script>if (a<b) '</p>'</script><!-- <p>no</p> --><p>a &lt; b &amp;amp; &nbsp; c&eacute;</p><p>1 < 2 and 3 > 2</p></article>": [LONG, LONG, "a < b &amp; cé", "1 < 2 and 3 > 2"],
    f"<div class=ad>buy<article><h1>T</h1><p>one\n\t <b>two</b><br>three<p>{LONG}</article>": ["T", "one two three", LONG],
    f"<body class='page has-sidebar'><div class='page-header-fixed'><div class='post-content'><p>{LONG}</p><p>{LONG}</p></div></div></body>": [LONG, LONG],
    f"<article><p><span class=ad>buy <span>this</span> now</span> and {LONG}</p><p hidden>h</p><p style='display: none'>{LONG}</p></article>": ["and " + LONG],
    "<article><p>One word</p></article>": ["One word"],
    "<nav><a href=a>a</a></nav><footer>b</footer>": [],
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text_of_pages(page):
    assert extract.main_text([page], extract.default_tree())[0].split("\n") == (PAGES[page] or [""])


def test_given_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in extract.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(x for x in parts if x)
        assert (found[r.page_id].text, found[r.page_id].n_chars, found[r.page_id].url) == (text, len(text), r.url)


def test_pages_of_the_rule_that_the_tree_has_not_seen():
    table = extract.labelled_pages(300, seed=99)
    labels = np.array([y for page in table for _, y in page])
    shares = extract.default_tree().shares(extract.features([[b for b, _ in page] for page in table]))
    assert ((shares >= 0.5) == labels).mean() > 0.99


def test_a_tree_of_two_features():
    rows = np.array([[x, y] for x in range(10) for y in range(10)], float)
    labels = ((rows[:, 0] > 4) & (rows[:, 1] > 6)).astype(int)
    tree = extract.train(rows, labels, least=1)
    assert (tree.shares(rows) == labels).all() and (tree.feature >= 0).sum() == 2


@pytest.mark.parametrize("piece", ["<", "<a ", "<!--", '<a "x>" ', "<div>", "<script>", "&", "<li><b>", "</div>", "<svg>", "<p><b>x<br>", "<b><div></b>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.perf_counter()
    extract.blocks_of(piece * (400_000 // len(piece)) + '"')
    assert time.perf_counter() - began < 8


def test_odd_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, key binary"
    rows = [(1, "u", None), (None, None, ""), (2, None, f"<article>{LONG}</article>"), (2, None, f"<article>{LONG}</article>"), (3, "v", "<article>" + f"<p>{LONG} 漢字 &copy</p>" * 20000)]
    pages = spark.createDataFrame([(*r, "clash", "n/a", b"k") for r in rows], schema).repartition(2)
    found = extract.main_texts(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.url or "", r.text[:30], r.n_chars) for r in found.collect())
    assert got == [(0, "", "", 0), (1, "u", "", 0), (2, "", LONG[:30], len(LONG)), (2, "", LONG[:30], len(LONG)), (3, "v", LONG[:30], 20000 * (len(LONG) + 6) - 1)]
    assert extract.main_texts(pages.where(F.lit(False))).collect() == []
