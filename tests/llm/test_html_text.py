"""Main text of pages: made pages whose article is known, the given pages, and markup gone wrong."""

import html
import random
import re
import time

import numpy as np
import pytest

from shelfwise.llm import html_text
from shelfwise.llm.html_text import main_text
from shelfwise.llm.queries import QUERIES

SCHEMA = "page_id bigint, url string, html string, text string, n_chars int, page string"
MENU = '<nav><ul><li><a href="/a">First</a></li><li><a href="/b">Second</a></li></ul></nav>'
LONG = "many words that make a paragraph of an article long enough to be seen as such, and some more of them"


@pytest.mark.parametrize("before, after", [
    ("", ""),
    (MENU, "<footer>&copy; all rights <p>" + LONG + "</p></footer>"),
    ('<div class="menu"><a href=x>One</a> | <a href=y>Two</a></div>', '<div id="sidebar-left"><p>' + LONG + "</p></div>"),
    ('<header><h1>Name of the site</h1><p>' + LONG + "</p></header>", "<aside>" + LONG + "</aside>"),
    ('<div class="cookie-notice">' + LONG + "</div>", '<section id="comments"><h3>Comments</h3><p>' + LONG * 5 + "</p></section>"),
    ('<form action="/s"><input name="q"><label>' + LONG + "</label></form>", '<div class="adBox">' + LONG + "</div>"),
    ('<script>var t = "</p><p>' + LONG + '";</script><style>p{}</style>', '<!-- <p>' + LONG + "</p> --><template>x</template>"),
    ('<ul><li><a href="1">' + LONG + '</a><li><a href="2">' + LONG + "</a></ul>", '<p hidden>' + LONG + "</p>"),
    ('<div role="navigation">' + LONG + "</div>", '<p class="ad">' + LONG + "</p>"),
])
@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<div>{}</div>"])
def test_article_alone_is_kept(before, after, holder):
    inside = (f"<h2>A &lt;title&gt; &amp;amp; more</h2><p>{LONG} <b>bold</b>er</p><p>Short.</p>"
              f"<div class='ad'>{LONG}</div><p>After an <a href='x'>advert</a>&#33;<br>Next\n\t line</p>")
    page = f"<!DOCTYPE html><html><head><title>{LONG}</title></head><body class='with-sidebar'>{before}{holder.format(inside)}{after}"
    wanted = f"A <title> &amp; more {LONG} bolder Short. After an advert! Next line"
    for end in ("</body></html>", ""):
        assert main_text(page + end) == wanted


@pytest.mark.parametrize("page, wanted", [
    (None, ""), ("", ""), ("  \n", ""), ("<html><body></body></html>", ""), ("just text &amp;\n more", "just text & more"),
    ("<p>a < b and c > d", "a < b and c > d"), ("<p>one<p>two</p></div></p>three", "one two three"),
    ("<p>x</p><script>never ends <p>y</p>", "x"), ("<p>x</p><!-- never ends <p>y</p>", "x"), ("<p>x</p><a href='", "x"),
    ('<p title="a>b<c">x</p>', "x"), ("<P CLASS=AD>no</P><P>yes</P>", "yes"), ("<article><p><a href=x>a link alone</a></p></article>", "a link alone"),
    ("<nav>only a menu</nav>", ""), ("&eacute;&#233;&#xe9;&nbsp;&xyzzy;", "ééé &xyzzy;"), ("<b>x</b>y<i>z</i>", "xyz"),
])
def test_small_pages(page, wanted):
    assert main_text(page) == wanted


def test_window_sums():
    keep = html_text.surges(np.array([0, 5, 0, 0, 0, 90, 0, 0, 10, 0, 0, 0, 0, 3]), 80)
    assert np.flatnonzero(keep).tolist() == [5, 6, 7, 8]
    assert html_text.surges(np.zeros(0, np.int64)).tolist() == [] and not html_text.surges(np.zeros(4, np.int64)).any()
    for seed in range(200):  # against the definition
        draw = random.Random(seed)
        weight = [draw.choice([0, 0, 0, 3, 30, 90]) for _ in range(draw.randrange(1, 30))]
        sums = [sum(weight[i:i + 3]) for i in range(len(weight))]
        wanted, at = set(), 0
        while at < len(weight):
            end = at
            while end < len(weight) and sums[end]:
                end += 1
            if end > at and max(sums[at:end]) >= min(80, max(sums) / 4):
                full = [i for i in range(at, end) if weight[i]]
                wanted |= set(range(full[0], full[-1] + 1))
            at = end + 1
        assert set(np.flatnonzero(html_text.surges(np.array(weight))).tolist()) == wanted


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "<!--", "<script>", "<div>", "</div>", "<div><p></section>", "<a <", "&", '"<a>', "<p>x"])
def test_time_grows_with_the_page(piece):
    start = time.perf_counter()
    main_text(piece * (2_000_000 // len(piece)))
    assert time.perf_counter() - start < 20


def test_tables(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 50_000
    rows = [(1, "u", "<p>x</p>", "t", 1, "p"), (1, "u", "<p>x</p>", "t", 1, "p"), (None, None, None, None, None, None), (2, "v", long, "t", 1, "p")]
    got = sorted((tuple(r) for r in html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    whole = " ".join([LONG] * 50_000)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, "v", whole, len(whole))], key=repr)
    assert html_text.extract_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_query(spark):
    folder = "/root/testdata/sf0.01"
    wanted = []
    for page, url, text in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect():
        article = re.search("<article>(.*?)</article>", text, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|br|h1)>", article)]
        whole = " ".join(b for b in blocks if b)
        wanted.append((page, url, whole, len(whole)))
    got = QUERIES["op12_html_extraction"](spark, folder)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)
