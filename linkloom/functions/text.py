"""Expressions on text: trimming, byte-exact cuts, lines, first matches."""

from __future__ import annotations

from linkloom import fixed_values as fixed
from linkloom.functions.sql import any_of, cases, let, quote


def strip(text: str) -> str:
    """Trim Unicode white space from both ends."""
    return f"btrim({text}, {quote(fixed.WHITE_SPACE)})"


def contains_any(text: str, parts: list[str]) -> str:
    """True if any of the parts occurs; byte search, no regex."""
    return any_of(f"contains({text}, {quote(part)})" for part in parts)


def matches(text: str, pattern: str) -> str:
    return f"rlike({text}, {quote(pattern)})"


def extract(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {quote(pattern)}, {group})"


def all_matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {quote(pattern)}, 0)"


def replace_all(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(by)})"


def first_group(text: str, pattern: str) -> str:
    """Group 1 of the first match, null without a match ('' is a legal hit)."""
    return let(extract(text, pattern, 0), lambda hit: f"if({hit} <> '', {extract(hit, pattern, 1)}, NULL)")


def head_bytes(text: str, size: int) -> str:
    """The longest prefix of at most `size` bytes that ends between characters."""

    def cut(raw: str) -> str:
        def between(back: int) -> str:  # no UTF-8 trail byte follows
            return f"substring({raw}, {size - back + 1}, 1) NOT BETWEEN X'80' AND X'BF'"

        length = cases([(between(back), str(size - back)) for back in range(3)], str(size - 3))
        return f"cast(substring({raw}, 1, {length}) AS string)"

    return let(f"cast({text} AS binary)", cut)


def head(array: str, most: int | None) -> str:
    """The first `most` items, or all."""
    return array if most is None else f"slice({array}, 1, {most})"


def shorten(text: str, limit: int | None) -> str:
    """At most `limit` bytes, the last three of them dots when text was cut."""
    if limit is None:
        return text
    return f"if(octet_length({text}) <= {limit}, {text}, concat({head_bytes(text, limit - 3)}, '...'))"


def shorten_at_blank(text: str, limit: int | None) -> str:
    """Cut at `limit` bytes, going back to a blank that is near enough to the end, plus dots."""
    if limit is None:
        return text

    def cut(start: str) -> str:
        def at_blank(blank: str) -> str:  # -1: there is none
            back = f"cast(substring(cast({start} AS binary), 1, {blank}) AS string)"
            return f"if({blank} > greatest(octet_length({start}) - {fixed.BLANK_REACH}, 0), {back}, {start})"

        return let(f"octet_length({start}) - octet_length(substring_index({start}, ' ', -1)) - 1", at_blank)

    return f"if(octet_length({text}) <= {limit}, {text}, concat({let(head_bytes(text, limit), cut)}, '...'))"


def lines(text: str) -> str:
    """Lines without their ends; after a final line end comes one more, empty line."""
    ends = quote("\\r?\\n")
    return f"if(contains({text}, '\\r'), split({text}, {ends}), split({text}, '\\n'))"
