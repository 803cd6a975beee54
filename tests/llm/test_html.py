"""Article text of made-up pages."""

import re
from html import unescape

import duckdb
import pytest

from quantloom.llm import html_text

WORDS = "Some plain words of an article that go on for a while, with a comma. "
SHELL = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>'
         '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- no -->{}'
         '<div id="sidebar">' + WORDS * 3 + '</div><section class="comments"><article class="comment"><p>' + WORDS * 40 + '</p></article></section>'
         '<form><p>Write to us</p></form><footer>&copy; all</footer></body></html>')


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Head &amp; tail</h1><p>One  <b>two</b>\n three&nbsp;four<p>Five<br>six</article>", "Head & tail\n\nOne two three four\n\nFive six"),
    ('<main><div class="ad">Buy</div><article><header><h1>H</h1></header><p>' + WORDS + '</p><aside>x</aside></article></main>', "H\n\n" + WORDS.strip()),
    ('<div class="content"><h1>H</h1><p>' + WORDS * 2 + "</p><p>" + WORDS + '</p><ul><li>a<li>b</ul></div>', "H\n\n" + (WORDS * 2).strip() + "\n\n" + WORDS.strip() + "\n\na\n\nb"),
    ("<article><p>Only &lt;this&gt; &#233;</p><script>x()</script><p>&am end</article>", "Only <this> é\n\n&am end"),
])
def test_article(body, text):
    assert html_text.main_text(SHELL.replace("{}", body)) == text


def test_broken_deep_and_empty():
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</p>") == "deep"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><head><title>x</title>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text("<article><p>a</p><p>b <scr") == "a\n\nb"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 30_000)) == 30_000 * 11 - 2


def test_given_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(path)).collect()}
    rows = duckdb.connect().execute(f"SELECT page_id, html FROM '{path}'").fetchall()
    assert len(got) == len(rows)
    for page_id, html in rows:  # these pages have a single article of flat paragraphs
        inner = re.search("<article>(.*?)(?:</article>|$)", html, re.S)[1]
        blocks = [" ".join(re.sub("<[^>]*>", " ", b).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[page_id] == unescape(want)
        assert got[page_id].count("\n") == 2 * got[page_id].count("\n\n") > 0
    empty = spark.createDataFrame([(None, None, None, 1, "t")], "page_id long, url string, html string, n_chars int, text string")
    assert [(r["text"], r["n_chars"]) for r in html_text.extract(empty).collect()] == [("", 0)]
    assert html_text.extract(empty.limit(0)).count() == 0
