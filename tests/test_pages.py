"""Page parsing and whole page records."""

import time

import pytest

from linkloom.limits import WHOLE, using
from linkloom.operators import pages
from linkloom.operators.elements import flatten, resolve
from linkloom.sources.readers import crawl_of_pages


@pytest.fixture(scope="module")
def page(spark):
    def build(html, url="https://www.site.org/a/b?c", **options):
        rows = spark.createDataFrame([(url, html)], "url string, html string")
        return pages.fetch(crawl_of_pages(rows), **options).first()

    return build


def _tags(html):
    body, elements = flatten(html, "https://x.org/")
    text = lambda e: body[e["begin"] : e["stop"]].decode() if "begin" in e else None
    return [(e["tag"], text(e)) for e in elements if e["tag"] != "#text"]


def test_new_paragraph_ends_the_open_one():
    assert _tags("<p>one<b>two<br><p>three</p>") == [("p", "onetwo"), ("p", "three")]
    assert _tags("<p>one<div>two</div>") == [("p", "one")]


def test_nested_elements_repeat_no_text():
    body, elements = flatten("<pre>abc" * 20_000, "")
    assert len(body) < 200_000 and len(elements) < 25_000
    assert len(elements) == 20_001  # the rendered text is one element: nothing divides it
    html = "<div>some text</div>"
    body, elements = flatten(html, "")
    assert body == b"some text" and [(e["begin"], e["stop"]) for e in elements] == [(0, 9)]  # normal text is not repeated


def test_rendered_text_follows_the_scope(page):
    html = "before<nav>menu</nav><main>one<div>two  \n three</div><article>four</article>five</main><p class='content'>six</p>"
    assert page(html).sections[0].content == "one\ntwo three\nfour\nfive"
    assert page(html, raw=True).sections[0].content == "before\nmenu\none\ntwo three\nfour\nfive\nsix"


def test_meta_without_content_hides_a_later_one(page):
    row = page('<meta name="author"><meta name="author" content="Late"><meta name="date" content="2020"><p>some text')
    assert (row.author, row.date) == (None, "2020")


def test_script_text_is_no_markup():
    assert _tags('<p>a<script>var t="</p><p>";</script>b</p>') == [("p", 'avar t="</p><p>";b')]
    assert _tags("<!-- <p>x</p> --><p>y</p>") == [("p", "y")]


def test_entities_and_odd_markup():
    assert _tags("<p>1 < 2 &amp; 3 &copy;</p><P CLASS=x>z") == [("p", "1 < 2 & 3 ©"), ("p", "z")]
    assert _tags("<p>a <a href=x title=it's>link</a>") [1] == ("a", "link")
    assert _tags("<p>cut <a href='never closed") == [("p", "cut ")]
    assert _tags("<p>cut <a href='never closed>x</a><p>y") == [("p", "cut ")]
    assert _tags("<p =x>a<a b=1 href=q>link</a><a href= >none</a><a b= href=q>-</a><i a='1'b='>'>c</i>") == [
        ("p", "alinknone-c"), ("a", "link"), ("a", "none"),  # in the third, `href=q` is the value of `b`
    ]


def test_inline_end_tag_does_not_end_a_block():
    assert _tags("<b><p>x</b>y</p>z") == [("p", "xy")]
    assert _tags("<i><b></i><h1>x</h1></b>t<h2>y") == [("h1", "x"), ("h2", "y")]
    assert _tags("<p><i><b><i></b></i></p><p>y") == [("p", ""), ("p", "y")]


@pytest.mark.parametrize(
    "href, url",
    [
        ("/x", "https://a.org/x"), ("y?z=1#q", "https://a.org/d/y?z=1#q"), ("../u", "https://a.org/u"),
        ("//b.org", "https://b.org/"), ("HTTP://B.org:80/P", "http://b.org/P"), ("/für", "https://a.org/f%C3%BCr"),
        ("/a b", "https://a.org/a%20b"), ("mailto:x@y.org", "mailto:x@y.org"), ("?n=2", "https://a.org/d/e?n=2"),
        ("/a,b.", "https://a.org/a,b."),
    ],
)
def test_resolve(href, url):
    assert resolve("https://a.org/d/e?f", href) == url


def test_metadata(page):
    r = page(
        '<title> </title><meta property="og:title" content=" T &amp; U "><meta name="author" content="N">'
        '<meta property="author" content=""><meta name="pubdate" content="P"><meta property="og:site_name" content="S">'
        '<meta name="DC.identifier" content="isbn"><a href="https://doi.org/10.1/x">doi</a><h1>H</h1>'
    )
    assert (r.title, r.site, r.author, r.date, r.doi) == ("T & U", "S", "N", "P", "https://doi.org/10.1/x")
    r = page('<h1> H </h1><meta name="DC.identifier" content="10.5/y"><meta name="author" content=" "><meta name="author" content="late">')
    assert (r.title, r.doi, r.author) == ("H", "10.5/y", None)  # only the first author element counts


def test_last_deepest_heading_gets_every_paragraph(page):
    html = "<main><h1>One</h1><p>first text</p><h2>Two</h2><p>second text</p><h2>Three</h2><p>ab</p><h1>Four</h1></main>"
    assert [tuple(s) for s in page(html).sections] == [(2, "Three", "first text\n\nsecond text")]
    assert page(html).chars == len("Three" + "first text\n\nsecond text")
    assert [tuple(s) for s in page(html, order="document").sections] == [(1, "One", "first text"), (2, "Two", "second text")]


def test_whole_text_without_heading_or_paragraph(page):
    (s,) = page("<body><div>Some <b>text</b></div><script>no</script><div>more</div><p>para</p>").sections
    assert (s.level, s.heading, s.content) == (1, "Content", "Some text\nmore\npara")
    (s,) = page("<h1>Only</h1>").sections
    assert (s.heading, s.content) == ("Content", "Only")
    assert page("<script>nothing</script>").sections == []
    (s,) = page("<div>" + "word " * 60 + "</div>").sections
    assert max(map(len, s.content.split("\n"))) <= 120 and s.content.split() == ["word"] * 60


def test_scope_priority(page):
    html = '<p class="content">by class</p><article><p>in article</p><h1>Art</h1></article><main><h2>Main</h2><p>in main</p></main>'
    assert [s.content for s in page(html).sections] == ["in main"]
    assert [s.content for s in page(html, raw=True).sections] == ["by class\n\nin article\n\nin main"]
    nested = '<div role="main"><h1>Role</h1><p>role text</p></div><div class="x entry-content"><h1>Entry</h1><p>entry</p></div>'
    assert [s.content for s in page(nested).sections] == ["role text"]


def test_links(page):
    html = (
        '<a href="/one">One</a><a href="">Empty</a><a href="#t">Top</a><a href="javascript:x">Js</a><a href="/no">ab</a>'
        '<a href="/no">later</a><a href="/one">Again</a><a>none</a><a href="mailto:a@b.c">Mail</a>'
        f'<a href="/long">{"x" * 101}</a>'
    )
    assert [tuple(x) for x in page(html).links] == [
        ("One", "https://www.site.org/one"), ("later", "https://www.site.org/no"), ("Mail", "mailto:a@b.c"),
        ("x" * 97 + "...", "https://www.site.org/long"),
    ]
    many = "".join(f'<a href="/{n}">link {n}</a>' for n in range(80))
    assert [x.text for x in page(many).links] == [f"link {n}" for n in range(50)]


def test_nav_links_stay_without_a_named_scope(page):
    html = '<nav><a href="/n">Nav link</a></nav><div><a href="/c">Content link</a></div>'
    assert len(page(html).links) == 2
    assert [x.text for x in page(html + '<main><a href="/m">Main link</a></main>').links] == ["Main link"]
    assert len(page(html + '<main><a href="/m">Main link</a></main>', raw=True).links) == 3


def test_code(page):
    html = (
        '<pre><code class="x language-lang-rust">fn main() {}</code></pre><pre class="lang-py">print("hello")</pre>'
        "<code>not in a pre block</code><pre>short</pre>"
    )
    assert [tuple(c) for c in page(html).code] == [("rust", "fn main() {}"), ("py", 'print("hello")')]


def test_code_cap_is_twenty_or_twenty_one(page):
    inner = "".join(f"<pre><code>inner block {n:03}</code> extra</pre>" for n in range(25))
    got = [c.source for c in page(inner).code]
    assert got == [f"inner block {n:03}" for n in range(20)] + ["inner block 000 extra"]
    few = "".join(f"<pre><code>inner block {n:03}</code></pre>" for n in range(5))
    outer = "".join(f"<pre>outer block {n:03}</pre>" for n in range(30))
    got = [c.source for c in page(few + outer).code]
    assert got == [f"inner block {n:03}" for n in range(5)] + [f"outer block {n:03}" for n in range(15)]


def test_outcomes(spark):
    crawl = spark.createDataFrame(
        [
            ("https://a.org", "https://a.org", "T", "<p>x", "net::ERR", 1),
            ("https://b.org", "https://c.org", "Moved", "<p>x", None, 1),
            ("https://d.org", "https://www.d.org", "D", "<h1>Wall</h1><p>Members Only</p>", None, 1),
            ("https://e.org", "https://e.org", "E", None, None, 1),
            ("https://g.org", "https://h.org", "Gone", None, None, 2),
            ("https://f.org", "https://f.org", "404", "<h1>Ok</h1><p>404 is fine here", None, 1),
            ("https://f.org", "https://f.org", "404", "<p>second try", None, 2),
        ],
        "url string, final_url string, title string, html string, error string, attempt int",
    )
    urls = spark.createDataFrame([(u,) for u in ["https://a.org", "https://f.org", "https://f.org", "https://none.org"]], "url string")
    rows = {r.url: r for r in pages.fetch(crawl).collect()}
    assert len(rows) == 6
    assert (rows["https://a.org"].status, rows["https://a.org"].alerts, rows["https://a.org"].sections) == ("dead", ["net::ERR"], None)
    moved = rows["https://b.org"]
    assert (moved.status, moved.title, moved.alerts, moved.links) == ("redirect", "Moved", ["Redirected to: https://c.org"], None)
    assert (rows["https://g.org"].status, rows["https://g.org"].title) == ("redirect", "Gone")
    wall = rows["https://d.org"]
    assert (wall.status, wall.alerts, wall.sections[0].content) == ("paywall", ["Paywall detected"], "Members Only")
    assert (rows["https://e.org"].status, rows["https://e.org"].title) == ("dead", None)
    assert (rows["https://f.org"].status, rows["https://f.org"].title) == ("ok", "Ok")
    listed = sorted((r.url, r.status, r.alerts) for r in pages.fetch(crawl, urls).collect())
    assert listed == [
        ("https://a.org", "dead", ["net::ERR"]), ("https://f.org", "ok", []), ("https://f.org", "ok", []),
        ("https://none.org", "dead", ["Not crawled"]),
    ]


def test_code_in_pre_follows_the_scope(page):
    html = "<pre>outer text <main><code>inner code one</code></main></pre><main><pre>x<i><code>inner code two</i></code> rest</pre></main>"
    assert [c.source for c in page(html).code] == []  # its `pre` is not in the main part
    html = "<main><pre><b><code>inner code one</b></code></pre><code>not in a block</code><pre>a whole block</pre></main><pre>other block</pre>"
    assert [c.source for c in page(html).code] == ["inner code one", "a whole block"]
    with using(WHOLE):
        twice = "<pre><code>inner code one</code></pre><pre>inner code one</pre><pre><code>inner code two</code></pre>"
        assert [c.source for c in page(twice).code] == ["inner code one", "inner code two"]


def _crowded(n):
    return "<main>" + "".join(
        f"<h2>Topic {i}</h2><p>Body {i} here</p><a href='/{i}'>link {i}</a><a href='/{i}'>again</a><pre><code>code block {i}</code></pre>" for i in range(n)
    ) + "</main>"


def test_whole_pages_take_linear_time(spark):
    def seconds(n):
        rows = crawl_of_pages(spark.createDataFrame([("https://x.org/", _crowded(n))], "url string, html string"))
        begin = time.perf_counter()
        with using(WHOLE):
            r = pages.fetch(rows, order="document").selectExpr("size(sections)", "size(links)", "size(code)", "sections[1]", "links[1]", "code[1].source").first()
        assert tuple(r)[:3] == (n, n, n) and tuple(r[4]) == ("link 1", "https://x.org/1") and r[5] == "code block 1"
        assert tuple(r[3]) == (2, "Topic 1", "Body 1 here")
        return time.perf_counter() - begin

    seconds(1_000)
    half, whole = min(seconds(8_000) for _ in range(2)), min(seconds(16_000) for _ in range(2))
    assert whole < 3 * half + 1
