"""Links of hand-written pages as a browser shows them."""

import pytest

from dropledger.operators.anchors import document_links
from tests.conftest import rows

KEY = r"typeB_([A-Za-z0-9_]+)[.]zip"


def links(spark, html, url=None):
    pages = spark.createDataFrame([(1, html, url)], "page_id long, html string, url string")
    got = document_links(pages, "html", KEY, url="url" if url else None)
    return sorted(rows(got, "pos", "link_key", "url", "link_text"))


@pytest.mark.parametrize("html, expected", [
    ("<a href=/d/typeB_tokyo.zip>Tokyo</a>", [(0, "tokyo", "/d/typeB_tokyo.zip", "Tokyo")]),
    ("<A CLASS=x HREF = '/typeB_a.zip' >A</A>", [(0, "a", "/typeB_a.zip", "A")]),
    ("<!-- <a href=/typeB_a.zip>A</a> --><a href=/typeB_b.zip>B</a>", [(0, "b", "/typeB_b.zip", "B")]),
    ("<!-- open <a href=/typeB_a.zip>A</a>", []),
    ("<script>var s = '<a href=/typeB_a.zip>A</a>';</script ><a href=/typeB_b.zip>B", [(0, "b", "/typeB_b.zip", "B")]),
    ("<style>/* <!-- */</style><a href=/typeB_b.zip>B</a>", [(0, "b", "/typeB_b.zip", "B")]),
    ("<a href=/typeB_a.zip>one<a href=/typeB_b.zip>two</a>", [(0, "a", "/typeB_a.zip", "one"), (1, "b", "/typeB_b.zip", "two")]),
    ("<a href='/typeB_a.zip?x=1&amp;y=2'>R&amp;D &lt;b&gt; &#26481;&#x4eac;&#0;</a>",
     [(0, "a", "/typeB_a.zip?x=1&y=2", "R&D <b> 東京\ufffd")]),
    ("<a href=/typeB_a.zip>&amp;lt;</a>", [(0, "a", "/typeB_a.zip", "&lt;")]),
    ('<img alt="<a href=/typeB_a.zip>"><a title="a > b" href="/typeB_b.zip">B</a>', [(0, "b", "/typeB_b.zip", "B")]),
    ('<a data-href="/typeB_a.zip">no</a><a title="href=/typeB_a.zip">no</a><abbr href=/typeB_a.zip>no</abbr>', []),
    ("<a href=/typeB_a.zip href=/typeB_b.zip>first</a>", [(0, "a", "/typeB_a.zip", "first")]),
    ("<a href=/typeB_a.zip>\n <b>x</b>\n y <img src=n> </a><a href=/typeB_A.zip>again</a>", [(0, "a", "/typeB_a.zip", "x y")]),
    ("<a href=/typeB_a.zip><img src=n></a><a>none</a><a/href=/typeB_b.zip>B</a>",
     [(0, "a", "/typeB_a.zip", "a"), (2, "b", "/typeB_b.zip", "B")]),
    ("\x01 href=/typeB_a.zip \x02 forged \x03", []),
    ("1 < 2 <a href=/typeB_a.zip>a < b</a>", [(0, "a", "/typeB_a.zip", "a < b")]),
    ("", []), (None, []),
])
def test_links_of_a_document(spark, html, expected):
    assert links(spark, html) == expected


@pytest.mark.parametrize("href, expected", [
    ("http://y.org/typeB_a.zip", "http://y.org/typeB_a.zip"), ("//y.org/typeB_a.zip", "https://y.org/typeB_a.zip"),
    ("/typeB_a.zip", "https://x.org/typeB_a.zip"), ("typeB_a.zip", "https://x.org/d/e/typeB_a.zip"),
    ("../typeB_a.zip", "https://x.org/d/typeB_a.zip"), ("../../../typeB_a.zip", "https://x.org/typeB_a.zip"),
    ("./f/./typeB_a.zip?p=../q", "https://x.org/d/e/f/typeB_a.zip?p=../q"), ("?f=typeB_a.zip", "https://x.org/d/e/p.html?f=typeB_a.zip"),
    ("#typeB_a.zip", "https://x.org/d/e/p.html?q=1#typeB_a.zip"), ("/typeB_a.zip/..", "https://x.org/"),
])
def test_addresses_are_resolved(spark, href, expected):
    got = links(spark, f'<a href="{href}">x</a>', "https://x.org/d/e/p.html?q=1#top")
    assert [r[2] for r in got] == ([expected] if "typeB_a" in expected else [])


def test_hostile_pages_end(spark):
    """Half a million characters of tags that never end, open anchors or quotes."""
    n = 500_000
    for html in ("<a " * (n // 3), "<a href='" * (n // 9), "<!-" * (n // 3), "<p x=\"" * (n // 6), "<b>" * (n // 3), "&#" * (n // 2)):
        assert links(spark, html + "<a href=/typeB_z.zip>z</a>") in ([], [(0, "z", "/typeB_z.zip", "z")])
    many = "".join(f"<a href=/typeB_{i}.zip>{i}</a>" for i in range(5000))
    assert len(links(spark, "<a href=/typeB_x.zip>" + "<b>x</b>" * 20_000 + many)) == 5001
