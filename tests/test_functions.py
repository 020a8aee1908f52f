"""Expressions on literal texts."""

import random
import time

import pytest

from linkloom import fixed_values as fixed
from linkloom.functions import facts, health, papers, text, urls
from linkloom.limits import WHOLE, limits, using


def test_urls_lose_their_tail_and_keep_first_seen_order(value):
    t = "See https://b.org/x. Then (https://a.org/y), <https://b.org/x>; http://c.org/?q=1`code`"
    assert value(urls.urls_in("t"), t=t) == ["https://b.org/x", "https://a.org/y", "http://c.org/?q=1"]


def test_urls_end_at_unicode_blanks(value):
    assert value(urls.urls_in("t"), t="https://a.org/x y https://b.org z") == ["https://a.org/x", "https://b.org"]


def test_repeated_url_counts_once(value):
    assert value(urls.urls_in("t"), t="https://d.com https://d.com, https://d.com.") == ["https://d.com"]


def test_links_before_bare_urls(value):
    t = "https://bare.org/p, [One](https://one.org). [Two](https://one.org) again https://one.org"
    got = [(m.url, m.title) for m in value(urls.mentions("t"), t=t)]
    assert got == [("https://one.org", "One"), ("https://one.org", "Two"), ("https://bare.org/p", None)]


def test_link_with_bracket_gives_a_second_shorter_url(value):
    got = [(m.url, m.title) for m in value(urls.mentions("t"), t="[q](https://q.org/a]b)")]
    assert got == [("https://q.org/a]b", "q"), ("https://q.org/a", None)]


@pytest.mark.parametrize(
    "url, host",
    [
        ("https://WWW.Example.com:8080/x", "example.com"),
        ("http://www.www.a.org?x=1", "a.org"),
        ("https://me:pw@a_b.com/p q", "a_b.com"),
        ("https://[2001:db8::1]:80/", "[2001:db8::1]"),
        ("https://münchen.de/", "xn--mnchen-3ya.de"),
        ("http:\\\\back.org\\x", "back.org"),
        ("mailto:a@b.org", None),
        ("no url", None),
        ("https://", None),
    ],
)
def test_host(value, url, host):
    assert value(urls.host("u"), u=url) == host


@pytest.mark.parametrize(
    "url, final, left",
    [
        ("https://a.org/x", "https://www.a.org/y", False),
        ("https://a.org/x", "https://b.org/x", True),
        ("https://a.org/x", None, False),
        ("junk", "https://b.org/x", False),
        ("https://münchen.de/", "https://xn--mnchen-3ya.de/", False),
    ],
)
def test_left_domain(value, url, final, left):
    assert value(urls.left_domain("u", "f"), u=url, f=final) is left


@pytest.mark.parametrize(
    "path, names",
    [
        ("docs/adr/ADR-001.md", ["documentation", "architecture"]),
        ("research/topic.md", ["research"]),
        ("README.md", ["readme"]),
        ("src/api/testing/x.md", ["api", "testing"]),
        ("tests.md", ["testing"]),
        ("a/LICENSE-CHANGELOG", ["changelog", "legal"]),
        ("random.md", ["general"]),
    ],
)
def test_categories(value, path, names):
    assert value(urls.categories("p"), p=path) == names


def test_fact_urls_by_pattern_then_place(value):
    t = "https://techcrunch.com/a, https://www.statista.com/s/1) https://instagram.com/u https://plain.org/x https://instagram.com/u."
    got = [(f.url, f.type) for f in value(urls.fact_urls("t"), t=t)]
    assert got == [
        ("https://instagram.com/u", "instagram"),
        ("https://www.statista.com/s/1", "statista"),
        ("https://techcrunch.com/a", "market"),
    ]


def test_fact_type_and_user_name(value):
    assert value(urls.fact_type("u"), u="https://instagram.com/user") == "instagram"
    assert value(urls.fact_type("u"), u="https://www.statista.com/s") == "statista"
    assert value(urls.fact_type("u"), u="https://techcrunch.com/x") == "generic"
    assert value(urls.user_name("u"), u="https://instagram.com/nasa//") == "nasa"
    assert value(urls.user_name("u"), u="https://instagram.com/nasa?x=1") == "nasa?x=1"


def test_amounts(value):
    got = [tuple(a) for a in value(facts.amounts("t"), t="worth $33 billion, then $48.2M, $7 , $5 Bananas, $. and $1,000.")]
    assert got == [
        ("33", "billion", "$33 billion"), ("48.2", "M", "$48.2M"), ("7", None, "$7 "), ("5", "B", "$5 B"),
        (".", None, "$. "), ("1,000.", None, "$1,000."),
    ]


def test_at_most_ten_facts(value):
    t = " ".join(f"${n} {n}%" for n in range(30))
    assert [a.value for a in value(facts.amounts("t"), t=t)] == [str(n) for n in range(10)]
    assert value(facts.percentages("t"), t=t) == [f"{n}%" for n in range(10)]


def test_percentages_followers_title(value):
    assert value(facts.percentages("t"), t="71% and 53 % or .%") == ["71%", "53 %", ".%"]
    assert value(facts.followers("t"), t="has 577K Followers, 3 followers") == "577K"
    assert value(facts.followers("t"), t="none") is None
    assert value(facts.quick_title("t"), t="<title>T</title><h1 class=x> Main </h1>") == "Main"
    assert value(facts.quick_title("t"), t="<title>T</title><h1><b>x</b></h1>") == "T"
    assert value(facts.quick_title("t"), t="<h1> </h1><title>T</title>") == ""
    assert value(facts.quick_title("t"), t="<H1>x</H1>") is None


@pytest.mark.parametrize(
    "title, error, status",
    [
        ("Page Not Found", None, 404), ("Error 403", None, 403), ("ACCESS DENIED", None, 403),
        ("Fortune 500", None, 500), ("Fine", None, 200), (None, None, 200), ("404", "net::X", 0),
    ],
)
def test_http_status(value, title, error, status):
    assert value(health.http_status("t", "e"), t=title, e=error) == status


@pytest.mark.parametrize(
    "error, name",
    [
        ("net::ERR_NAME_NOT_RESOLVED", "DNS_FAILED"), ("ERR_CONNECTION_REFUSED", "CONNECTION_REFUSED"),
        ("ERR_CONNECTION_TIMED_OUT", "TIMEOUT"), ("ERR_CERT_X", "SSL_ERROR"), ("bad SSL", "SSL_ERROR"),
        ("random error", "NETWORK_ERROR"), (None, None),
    ],
)
def test_error_class(value, error, name):
    assert value(health.error_class("e"), e=error) == name


@pytest.mark.parametrize(
    "html, paywall, login",
    [
        ("<div>Subscribe to Continue reading</div>", True, False),
        ("<div class='paywall-overlay'>x</div>", True, False),
        ("<p id=x class=\"a piano-offer-1\">", True, False),
        ("<div>Please sign in to continue</div>", False, True),
        ("<div data-x='y' CLASS='login-wall'>x</div>", False, True),
        ("<div id=the-login-modal>", False, True),
        ("<div class=login-modal>", False, False),
        ("<div class='Login-Wall'>", False, False),
        ("<!-- <div class='login-wall'> -->", False, False),
        ("<script>'<div class=\"auth-wall\">'</script>", False, False),
        ("<div title='class=auth-wall'>", False, False),
        ("auth-wall in text", False, False),
        ("<div>Normal content</div>", False, False),
    ],
)
def test_walls(value, html, paywall, login):
    assert value(health.is_paywall("h"), h=html) is paywall
    assert value(health.is_login_wall("h"), h=html) is login


def test_walls_of_endless_markup(value):
    """Java neither runs out of stack nor tries a character twice."""
    many = "<div " + " ".join(f'a{n}="v"' for n in range(20_000))
    assert value(health.is_paywall("h"), h=f"paywal <i>piano-offer</i>{many} class='x piano-offer'>") is True
    assert value(health.is_paywall("h"), h=f"<i>piano-offer</i>{many}>") is False
    assert value(health.is_login_wall("h"), h="gate-content " + "<script " * 20_000) is False
    assert value(health.is_login_wall("h"), h="gate-content " + "<script>" * 20_000) is False
    assert value(health.is_login_wall("h"), h="gate-content " + '<a b="' * 20_000) is False


def test_page_wall_has_its_own_phrases(value):
    assert value(health.page_wall("h"), h="Unlock This Article") == "paywall"
    assert value(health.page_wall("h"), h="create an account to read") == "login"
    assert value(health.page_wall("h"), h="create an account") == "ok"
    assert value(health.page_wall("h"), h="paid subscribers") == "ok"


def _floor(s, size):
    return s.encode()[:size].decode(errors="ignore")


def test_cuts_are_byte_exact(spark):
    random.seed(5)
    samples = ["", "short", "this is a long string", "─" * 100]
    samples += ["".join(random.choice("ab é─𝄞") for _ in range(random.randint(0, 90))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for limit in (10, 20, 61):
        rows = df.selectExpr(
            "t", f"{text.shorten('t', limit)} AS plain", f"{text.shorten_at_blank('t', limit)} AS blank"
        ).collect()
        for t, plain, blank in rows:
            if len(t.encode()) <= limit:
                assert plain == blank == t
                continue
            assert plain == _floor(t, limit - 3) + "..."
            head = _floor(t, limit)
            at = len(head[: head.rfind(" ")].encode()) if " " in head else -1
            expected = head[: head.rfind(" ")] if at > max(len(head.encode()) - 50, 0) else head
            assert blank == expected + "..."


def test_shorten_example(value):
    assert value(text.shorten("t", 10), t="this is a long string") == "this is..."


@pytest.mark.parametrize(
    "line, yes",
    [
        ("INTRODUCTION", True), ("2 METHODS AND DATA", True), ("2. METHODS", True), ("Chapter 3 begins", True),
        ("Section x", False), ("ABCd", True), ("ABcd", False), ("ABC", True), ("A", False), ("ÄÖÜ x", False),
        ("ÄÖÜÄ", False), ("HELLO World", True), ("HELLO Worlds", False), ("A" * 99 + "b", False), ("NASA-ESA-1", True),
    ],
)
def test_heading(value, line, yes):
    assert value(papers.is_heading("t"), t=line) is yes


def test_heading_level(value):
    for heading, level in [("1. X", 2), ("1.2.3 X", 3), ("X 1.2", 1), (".1", 1), ("1.1.1.1.1.1.1.", 6)]:
        assert value(papers.heading_level("t"), t=heading) == level


def test_paper_fields(value):
    t = "x\nwritten by:  Jane Roe \nUpdated: March 5, 2021\nsee https://doi.org/10.1234/abc) and"
    assert value(papers.author("t"), t=t) == "Jane Roe"
    assert value(papers.date("t"), t=t) == "March 5, 2021"
    assert value(papers.doi("t"), t=t) == "10.1234/abc"
    assert value(papers.doi("t"), t="This paper (DOI: 10.1234/abc.123) presents") == "10.1234/abc.123"
    assert value(papers.author("t"), t="by " + "a" * 200) is None
    assert value(papers.date("t"), t="Date 2020/01/02") == "2020/01/02"
    assert value(papers.date("t"), t="nothing") is None


def test_paper_links_keep_backticks(value):
    got = [l.url for l in value(papers.links("t"), t="https://a.org/`x` https://b.org. https://b.org")]
    assert got == ["https://a.org/`x`", "https://b.org"]


@pytest.mark.parametrize(
    "source, lang",
    [
        ("fn main() -> i32 { 42 }", "rust"), ("def foo(): pass", "python"), ("let x = 1", "javascript"),
        ("public class A", "java"), ("#include <x>", "c"), ("nothing", None),
    ],
)
def test_language(value, source, lang):
    assert value(papers.language("t"), t=source) == lang


def test_brackets_that_start_no_link(value):
    t = "[a][b](https://b.org) [] [c [d](https://d.org) [e](ftp://e) [f](https://f.org ) [g] (https://g.org) [z (https://z.org)"
    got = [(l.url, l.title) for l in value(urls.markdown_links("t"), t=t)]
    assert got == [("https://b.org", "b"), ("https://d.org", "c [d")]


def test_long_runs_take_no_quadratic_time(value):
    digits, brackets = "1,." * 50_000, "[" * 150_000
    start = time.monotonic()
    assert value(facts.percentages("t"), t=digits + "x 5%") == ["5%"]
    assert value(facts.followers("t"), t=digits + " 7K followers") == "7K"
    assert value(urls.markdown_links("t"), t=brackets) == []
    assert [l.url for l in value(urls.markdown_links("t"), t=brackets + "](x) [a](https://a.org)")] == ["https://a.org"]
    assert time.monotonic() - start < 30


def test_fixed_lists_hold_no_pattern_signs():
    for rules in (fixed.PAYWALL_ATTRIBUTES, fixed.LOGIN_ATTRIBUTES):
        assert all(part.replace("-", "").isalpha() for _, parts in rules for part in parts)


def test_nothing_is_cut_without_limits(value):
    many = " ".join(f"{n}%" for n in range(30))
    assert value(f"size({facts.percentages('t')})", t=many) == 10
    with using(WHOLE):
        assert value(f"size({facts.percentages('t')})", t=many) == 30
        assert value(text.shorten("t", limits().link_text_bytes), t="x" * 500) == "x" * 500
