"""How much of a text or page the operators report.

Results are whole by default.  `ESTABLISHED` gives the cuts that results of the
tool this engine stands in for have:

    with using(ESTABLISHED):
        records = pages.fetch(crawl)

Expressions take the limits that hold while they are built.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from linkloom import fixed_values as fixed


@dataclass(frozen=True)
class Limits:
    """Numbers of items and sizes in bytes; None cuts nothing."""

    facts_per_text: int | None = None
    links_per_page: int | None = None
    sections_per_page: int | None = None
    code_per_page: int | None = None
    sections_per_paper: int | None = None
    links_per_paper: int | None = None
    code_per_paper: int | None = None
    heading_bytes: int | None = None
    paragraph_bytes: int | None = None
    link_text_bytes: int | None = None
    code_bytes: int | None = None
    section_bytes: int | None = None
    fallback_lines: int | None = None
    fallback_bytes: int | None = None


WHOLE = Limits()
ESTABLISHED = Limits(**{name: getattr(fixed, name.upper()) for name in Limits.__dataclass_fields__})
_current: ContextVar[Limits] = ContextVar("limits", default=WHOLE)


def limits() -> Limits:
    return _current.get()


@contextmanager
def using(chosen: Limits) -> Iterator[None]:
    token = _current.set(chosen)
    try:
        yield
    finally:
        _current.reset(token)
