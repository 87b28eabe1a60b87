"""Pages of awkward shapes: stray quotes, self-closed raw elements, teasers, names in compounds, shared text."""

import time

import pytest

from panelspark.llm.html_text import Wrapper, extract_text, main_text, parse


def text_of(html):
    return main_text(parse(html), Wrapper(None)).split("\n\n")


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><p>One.</p><p title=it's>Second</p><p>Third</p><p>I don't know.</p></article>", ["One.", "Second", "Third", "I don't know."]),
        ("<article><p title = \"a>b\" x='>'>A</p><p a==\"q\" b=c\"d>B</p><p c=>C</p></article>", ["A", "B", "C"]),
        ("<article><p>A</p><script src=\"x.js\"/>var leak=1;</script><style media=a/>.x{}</style><p>B</p></article>", ["A", "B"]),
        ("<article><p>A <svg/>b <svg viewBox='0 0'/>c</p><p><a href=/x/>link</a></p></article>", ["A b c", "link"]),
        ("<div class=content><p>The main text, which is long enough.</p><p>And goes on.</p></div><article class=card>Teaser</article><article class=card>More</article>", ["The main text, which is long enough.", "And goes on."]),
        ("<article><p>Text.</p><div class='related-posts'>x</div><div class='newsletter-signup'>x</div><div class=ad-slot>x</div></article>", ["Text."]),
        ("<div><p>Text of the page.</p><div class=user-comments>x</div><ol class=commentlist><li>x</ol><div class=entry-comments>x</div></div>", ["Text of the page."]),
        ("<div><header class='entry-header'><h1>Title</h1></header><p>Text.</p></div><header class='site-header'>Site</header>", ["Title", "Text."]),
        ("<article><h2>Summary</h2><p>a</p></article><p", ["Summary", "a"]),
        ("", [""]),
        ("<a href=\"never closed", [""]),
    ],
)
def test_shapes(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("piece", ['<a href="x ', "<!", "<a b='", "<p =", "</", "<script>", "<!--", "<svg a=", "<div class=a>"])
def test_reading_takes_linear_time(piece):
    parse(piece * 500)
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        parse(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 0.2


def test_shared_text(spark):
    """Of pages of one host: blocks that all share go, but headings of an article stay; copies keep theirs."""
    words = lambda k: f"own words {k} of page {k * 7} and no other"
    rows = [(k, "http://a.com/", f"<div><p>This site is made by us, with care and for everybody who likes it.</p></div><div><p>{words(k)}</p></div>") for k in range(12)]
    rows += [(20 + k, "http://b.com/", f"<article><h2>Summary</h2><p>{words(k)}</p><p>Share this.</p><div>Print this</div></article>") for k in range(12)]
    rows += [(40 + k, "http://c.com/", "<div><p>The same page again.</p></div>") for k in range(5)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == words(k) for k in range(12))
    assert all(got[20 + k] == f"Summary\n\n{words(k)}" for k in range(12))
    assert all(got[40 + k] == "The same page again." for k in range(5))
