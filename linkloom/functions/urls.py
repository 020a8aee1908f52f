"""Expressions on URLs: finding, cleaning, comparing and sorting them."""

from __future__ import annotations

from linkloom import fixed_values as fixed
from linkloom.functions.sql import any_of, array_of, cases, each, keep, let, quote, record
from linkloom.functions.text import all_matches, contains_any, extract, matches, replace_all


def drop_tail(url: str, tail: str = fixed.URL_TAIL) -> str:
    """Cut trailing punctuation, repeatedly."""
    return f"trim(TRAILING {quote(tail)} FROM {url})"


def _found(text: str, pattern: str, tail: str) -> str:
    return f"array_distinct({each(all_matches(text, pattern), lambda hit: drop_tail(hit, tail))})"


def urls_in(text: str) -> str:
    """Distinct URLs of a text in first-seen order."""
    return _found(text, fixed.URL, fixed.URL_TAIL)


def urls_in_paper(text: str) -> str:
    """As `urls_in`, but a backtick does not end a URL."""
    return _found(text, fixed.URL_KEEPING_BACKTICKS, fixed.URL_TAIL)


def markdown_links(text: str) -> str:
    """`[title](url)` links in order, duplicates kept: array<struct<url, title>>."""
    # One search of the whole text; the groups are then read from the short hits.
    # Where a bracket starts no link, the second branch passes over all up to
    # its end.  No bracket in between can start one either, and trying them
    # all would take quadratic time on a text with many open brackets.
    link_or_bracket = rf"{fixed.MARKDOWN_LINK}|\[[^\]]*+(?:\]|\z)"
    hits = keep(all_matches(text, link_or_bracket), lambda hit: f"contains({hit}, '](http')")
    return each(
        hits,
        lambda hit: record(
            url=drop_tail(extract(hit, fixed.MARKDOWN_LINK, 2)), title=extract(hit, fixed.MARKDOWN_LINK, 1)
        ),
    )


def bare_urls(text: str, links: str) -> str:
    """URLs of a text that are not already the target of one of its links."""
    return f"array_except({urls_in(text)}, {links}.url)"


def mentions(text: str) -> str:
    """All links, then all bare URLs with a null title: array<struct<url, title>>."""

    def linked_and_bare(links: str) -> str:
        bare = each(bare_urls(text, links), lambda url: record(url=url, title="cast(NULL AS string)"))
        return f"concat({links}, {bare})"

    return let(markdown_links(text), linked_and_bare)


def host(url: str) -> str:
    """Comparable host: lower case, ASCII form, without user, port and leading `www.`.

    Null when the URL has no usable host.
    """
    web = r"(?i)^(?:https?|wss?|ftp):[/\\]*([^/\\?#]*)"
    other = r"(?i)^(?!file:)[a-z][a-z0-9+.-]*://([^/?#]*)"
    authority = let(
        f"translate(btrim({url}), '\t\n\r', '')",
        lambda clean: f"if({matches(clean, web)}, {extract(clean, web, 1)}, {extract(clean, other, 1)})",
    )
    name = extract(authority, r"^(?:.*@)?(\[[0-9A-Fa-f:.]+\]|[^:@\[\]]*)(?::[0-9]*)?$", 1)

    def in_ascii(raw: str) -> str:
        converted = f"try_reflect('java.net.IDN', 'toASCII', {raw})"
        return f"if({matches(raw, r'[^\x00-\x7F]')}, {converted}, {raw})"

    def without_www(raw: str) -> str:
        usable = f"{raw} <> '' AND NOT {matches(raw, r'[\x00-\x20<>^|%\x7F]')}"
        return f"if({usable}, {replace_all(f'lower({raw})', r'^(?:www\.)+', '')}, NULL)"

    return let(let(name, in_ascii), without_www)


def left_domain(url: str, final_url: str) -> str:
    """True if the final URL is on another host; false when either host is unknown."""
    # the usual case, equal text, needs no parsing
    return f"coalesce({url} <> {final_url} AND {host(url)} <> {host(final_url)}, false)"


def fact_type(url: str) -> str:
    """Which kind of facts a single URL is read for."""
    return cases([(f"contains({url}, {quote(part)})", quote(name)) for part, name in fixed.FACT_HOSTS], "'generic'")


def fact_urls(text: str) -> str:
    """URLs of a text that carry facts: array<struct<url, type>>.

    By pattern first and position second.  A URL's own start decides which
    pattern finds it, so distinct per pattern is distinct over all of them.
    """
    found = [
        each(_found(text, pattern, fixed.FACT_URL_TAIL), lambda url: record(url=url, type=quote(kind)))
        for kind, pattern in fixed.FACT_URL_PATTERNS
    ]
    return f"concat({', '.join(found)})"


def user_name(url: str) -> str:
    """Last path piece, trailing slashes ignored; a query string stays."""
    return f"substring_index({drop_tail(url, '/')}, '/', -1)"


def categories(path: str) -> str:
    """Categories read off a file path, in rule order; `general` if none fits."""

    def rules(low: str) -> str:
        hits = []
        for name, parts, prefixes in fixed.CATEGORY_RULES:
            tests = [contains_any(low, parts), *(f"startswith({low}, {quote(p)})" for p in prefixes)]
            hits.append(f"if({any_of(tests)}, {quote(name)}, NULL)")
        return f"array_compact(array({', '.join(hits)}))"

    default = array_of([fixed.DEFAULT_CATEGORY])
    return let(let(f"lower({path})", rules), lambda found: f"if(size({found}) = 0, {default}, {found})")
