"""Expressions that read facts off a text or raw HTML."""

from __future__ import annotations

from linkloom import fixed_values as fixed
from linkloom.functions.sql import each, record
from linkloom.functions.text import all_matches, extract, first_group, head, strip
from linkloom.limits import limits


def _from_run_start(pattern: str) -> str:
    """The same pattern, tried once per run of digits instead of at every digit.

    A match that fails at the start of a run fails at its other digits too.
    """
    return pattern.replace("([0-9,.]+", "(?<![0-9,.])([0-9,.]++")


def amounts(text: str) -> str:
    """Dollar amounts: array<struct<value, unit, raw>>, unit null if none is given."""
    return each(
        head(all_matches(text, fixed.AMOUNT), limits().facts_per_text),
        lambda raw: record(
            value=extract(raw, fixed.AMOUNT, 1), unit=f"nullif({extract(raw, fixed.AMOUNT, 2)}, '')", raw=raw
        ),
    )


def percentages(text: str) -> str:
    """Percentages, as written."""
    return head(all_matches(text, _from_run_start(fixed.PERCENTAGE)), limits().facts_per_text)


def followers(text: str) -> str:
    """First follower count, null without one."""
    return first_group(text, _from_run_start(fixed.FOLLOWERS))


def quick_title(html: str) -> str:
    """Text of the first plain `h1`, else of the first plain `title`; may be ''."""
    return strip(f"coalesce({first_group(html, fixed.H1_TEXT)}, {first_group(html, fixed.TITLE_TEXT)})")
