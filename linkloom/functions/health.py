"""Expressions that judge a fetch: status, error class, walls, verdict."""

from __future__ import annotations

from linkloom import fixed_values as fixed
from linkloom.functions.sql import any_of, cases, let, quote, record, some
from linkloom.functions.text import all_matches, contains_any, matches, replace_all
from linkloom.functions.urls import left_domain


def http_status(title: str, error: str) -> str:
    """HTTP-like status: 0 after an error, else read off the page title."""

    def by_title(low: str) -> str:
        return cases([(contains_any(low, phrases), str(code)) for code, phrases in fixed.TITLE_CODES], "200")

    return f"if({error} IS NOT NULL, 0, {let(f'lower({title})', by_title)})"


def error_class(error: str) -> str:
    """Name of the kind of network error, null without an error."""
    known = [(contains_any(error, parts), quote(kind)) for kind, parts in fixed.ERROR_CLASSES]
    return cases([(f"{error} IS NULL", "NULL"), *known], quote(fixed.OTHER_ERROR))


# An attribute, with its value if it has one.  Loops are possessive, and what never ends goes on to the end of
# the text: so Java runs them without recursion, and no character is tried twice.
_ATTRIBUTE = r"""[\s/]++[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+))?+"""
_START_TAG = rf"<[a-zA-Z][^\s/>]*+(?:{_ATTRIBUTE})*+"
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|(<(script|style|noscript|iframe|textarea|title|xmp)\b[^>]*+(?:>|\z)).*?(?:</\2\b|\z)"


def attribute_test(html: str, rules: list[tuple[str, list[str]]]) -> str:
    """True if an element carries one of the parts in the named attribute.

    A byte search for the parts comes first and settles nearly every page.
    The rest is judged attribute by attribute on start tags, with comments and
    raw text taken out.
    """
    tags = all_matches(replace_all(html, _UNSEEN, "$1"), _START_TAG)

    def carried(tag: str) -> str:
        tests = []
        for name, parts in rules:
            own = rf"^[\s/]++(?i:{name})\s*+=(?s:.*)(?:{'|'.join(parts)})"  # parts hold no special characters
            found = some(all_matches(tag, _ATTRIBUTE), lambda a, own=own: matches(a, own))
            tests.append(f"({contains_any(tag, parts)} AND {found})")
        return any_of(tests)

    every = list(dict.fromkeys(part for _, parts in rules for part in parts))
    return f"({contains_any(html, every)} AND {some(tags, carried)})"


def is_paywall(html: str, lower_html: str | None = None) -> str:
    phrases = contains_any(lower_html or f"lower({html})", fixed.PAYWALL_PHRASES)
    return f"({phrases} OR {attribute_test(html, fixed.PAYWALL_ATTRIBUTES)})"


def is_login_wall(html: str, lower_html: str | None = None) -> str:
    phrases = contains_any(lower_html or f"lower({html})", fixed.LOGIN_PHRASES)
    return f"({phrases} OR {attribute_test(html, fixed.LOGIN_ATTRIBUTES)})"


def verdict(url: str, final_url: str, title: str, html: str, error: str) -> str:
    """struct<status, notes> of a registry entry, by the first rule that applies."""

    def outcome(status: str, notes: str = "cast(NULL AS string)") -> str:
        return record(status=quote(status), notes=notes)

    def by_content(low: str) -> str:
        return cases(
            [
                (f"{low} IS NULL", outcome("ok")),
                (is_paywall(html, low), outcome("paywall", quote(fixed.PAYWALL_NOTE))),
                (is_login_wall(html, low), outcome("login", quote(fixed.LOGIN_NOTE))),
            ],
            outcome("ok"),
        )

    def by_status(status: str) -> str:
        return cases(
            [
                (f"{error} IS NOT NULL", outcome("dead", error)),
                (f"{status} = 404 OR {status} >= 500", outcome("dead", f"concat('HTTP ', {status})")),
                (left_domain(url, final_url), outcome("redirect", final_url)),
            ],
            let(f"lower({html})", by_content),
        )

    return let(http_status(title, error), by_status)


def page_wall(html: str) -> str:
    """Status of a structured page by its raw HTML: paywall, login or ok."""
    return let(
        f"lower({html})",
        lambda low: cases(
            [
                (contains_any(low, fixed.PAGE_PAYWALL_PHRASES), "'paywall'"),
                (contains_any(low, fixed.PAGE_LOGIN_PHRASES), "'login'"),
            ],
            "'ok'",
        ),
    )
