"""Expressions that give the text of a paper its structure.

All of them work inside one row: a paper never has to be split into rows and
brought together again, so none of them shuffles.
"""

from __future__ import annotations

from linkloom import fixed_values as fixed
from linkloom.functions.sql import any_of, cases, each, each_numbered, first, keep, let, pairs, quote, record
from linkloom.functions.text import (
    contains_any, extract, first_group, head, matches, replace_all, shorten, strip,
)
from linkloom.limits import limits
from linkloom.functions.urls import urls_in_paper


def is_heading(line: str) -> str:
    """Does a trimmed line look like a heading?"""
    capitals = f"length({replace_all(line, r'\P{IsUppercase}', '')})"
    size = f"octet_length({line})"
    return f"({matches(line, fixed.HEADING)} OR ({size} > 3 AND {size} < 100 AND {capitals} * 2 > {size}))"


def heading_level(heading: str) -> str:
    """1 + the dots of a leading number, at most 6."""
    number = extract(heading, r"^\p{N}[\p{N}.]*", 0)
    return f"least(6, 1 + length({replace_all(number, '[^.]', '')}))"


def _outline(trimmed: str) -> str:
    """A paper's lines as signs: `H` or `l` begins a line, then as many signs as it adds bytes to a section, with a ceiling.

    A blank line adds two (`bb`), any other its bytes (`x`) and a blank (`s`) behind one that is not blank.
    """

    def signs(line: str, number: str) -> str:
        joined = f"if(coalesce(get({trimmed}, {number} - 1), '') = '', '', 's')"
        size = f"least(octet_length({line}), {fixed.SECTION_OPENING_BYTES + 1})"
        return f"if({line} = '', 'lbb', concat(if({is_heading(line)}, 'H', 'l'), {joined}, repeat('x', {size})))"

    return f"array_join({each_numbered(trimmed, signs)}, '')"


def section_starts(trimmed: str) -> str:
    """Indexes (from 0) of the lines that open a section.

    Whether a heading opens one depends on how many bytes the running section
    holds, which depends on where it was opened.  A regular expression walks
    the outline once: a section is its heading, what is not counted at its
    beginning, as many signs as let a heading open the next one, and the rest up
    to that heading.  All quantifiers are possessive, so nothing is tried twice.
    """
    enough = fixed.SECTION_OPENING_BYTES + 1
    pattern = rf"(?:^|Hs?+x++)(?:lbb)*+[lH]?+s?+(?:[lH]?+[sxb]){{0,{enough}}}+[lsxb]*+"

    def marks(section: str) -> str:  # a sign per line, the first one raised
        return f"rpad('O', length(translate({section}, 'sxb', '')), '.')"

    def raised(flags: str) -> str:
        return keep(f"sequence(0, size({trimmed}) - 1)", lambda i: f"{i} > 0 AND substring({flags}, {i} + 1, 1) = X'4F'")

    parts = f"regexp_extract_all({_outline(trimmed)}, {quote(pattern)}, 0)"
    return let(f"cast(array_join({each(parts, marks)}, '') AS binary)", raised)


def sections(raw_lines: str) -> str:
    """array<struct<level, heading, content>> of a paper's lines."""
    return let(
        each(raw_lines, strip),
        lambda trimmed: let(section_starts(trimmed), lambda starts: _sections_between(trimmed, starts)),
    )


def _sections_between(trimmed: str, starts: str) -> str:
    most = limits().sections_per_paper

    def whole(edge: str, number: str) -> str:
        until = f"coalesce(get({starts}, {number}), size({trimmed}))"
        body = f"slice({trimmed}, {edge} + 2, greatest({until} - {edge} - 1, 0))"
        # blank lines become paragraph breaks, other line ends one blank
        joined = f"array_join({each(body, lambda t: f"if({t} = '', '\n\n', {t})")}, ' ')"
        return record(
            heading=f"if({edge} < 0, {quote(fixed.FALLBACK_HEADING)}, get({trimmed}, {edge}))",
            numbered=f"{edge} >= 0",
            content=strip(replace_all(joined, " ?\n\n ?", "\n\n")),
        )

    def limited(s: str) -> str:
        return record(
            level=f"cast(if({s}.numbered, {heading_level(f'{s}.heading')}, 1) AS tinyint)",
            heading=shorten(f"{s}.heading", limits().heading_bytes),
            content=shorten(f"{s}.content", limits().section_bytes),
        )

    # Only the last section can be empty: every other one passed the byte test.
    edges = head(f"concat(array(-1), {starts})", most and most + 1)
    kept = keep(each_numbered(edges, whole), lambda s: f"{s}.content <> ''")
    return each(head(kept, most), limited)


def is_code_line(line: str) -> str:
    indented = [f"startswith({line}, {quote(indent)})" for indent in fixed.CODE_INDENTS]
    return any_of([contains_any(line, fixed.CODE_TOKENS), *indented])


def code_islands(raw_lines: str) -> str:
    """Runs of at least three code lines: array<struct<lang, source>>."""
    return let(
        raw_lines,
        lambda kept: let(
            each(kept, is_code_line), lambda flags: let(_runs(flags), lambda runs: _islands(kept, runs))
        ),
    )


def _runs(flags: str) -> str:
    """array<struct<first, count>> of runs of raised flags.

    A run starts where a flag is up and its left neighbour is not, and ends
    where its right neighbour is not; the n-th start belongs to the n-th end.
    """

    def up(at: str) -> str:
        return f"coalesce(get({flags}, {at}), false)"

    here = f"sequence(0, size({flags}) - 1)"
    starts = keep(here, lambda i: f"{up(i)} AND NOT {up(f'{i} - 1')}")
    ends = keep(here, lambda i: f"{up(i)} AND NOT {up(f'{i} + 1')}")
    return pairs(starts, ends, lambda a, b: record(first=a, count=f"{b} - {a} + 1"))


def _islands(raw_lines: str, runs: str) -> str:
    long_runs = keep(runs, lambda run: f"{run}.count >= {fixed.SHORTEST_RUN}")
    joined = each(long_runs, lambda run: f"array_join(slice({raw_lines}, {run}.first + 1, {run}.count), '\n')")
    sources = keep(joined, lambda source: f"octet_length({source}) >= {fixed.SHORTEST_ISLAND}")
    return each(
        head(sources, limits().code_per_paper),
        lambda source: record(lang=language(source), source=shorten(source, limits().code_bytes)),
    )


def language(source: str) -> str:
    """Guess a programming language, null if nothing fits."""

    def has(kind: str, parts: list[str]) -> str:
        return {"all": " AND ", "any": " OR "}[kind].join(f"contains({source}, {quote(part)})" for part in parts)

    return cases((has(kind, parts), quote(name)) for name, kind, parts in fixed.CODE_LANGUAGES)


def title(raw_lines: str, path: str) -> str:
    """First non-blank line if its length is reasonable, else the file's stem."""
    line = first(keep(raw_lines, lambda text: f"{strip(text)} <> ''"))
    sized = let(
        strip(line),
        lambda t: f"if(octet_length({t}) > 3 AND octet_length({t}) < {fixed.LONGEST_NAME}, {t}, NULL)",
    )
    stem = replace_all(extract(path, r"([^/]+)/*\z", 1), r"(?<=.)\.[^.]*\z", "")
    return f"coalesce({sized}, nullif({stem}, ''))"


def author(text: str) -> str:
    return let(
        strip(first_group(text, fixed.AUTHOR)),
        lambda name: f"if(octet_length({name}) < {fixed.LONGEST_NAME}, {name}, NULL)",
    )


def date(text: str) -> str:
    return first_group(text, fixed.DATE)


def doi(text: str) -> str:
    # a byte search spares most texts the regular expression
    return f"if(contains({text}, '10.'), {first_group(text, fixed.DOI)}, NULL)"


def links(text: str) -> str:
    """Distinct URLs: array<struct<text, url>>."""
    return each(
        head(urls_in_paper(text), limits().links_per_paper),
        lambda url: record(text=shorten(url, limits().link_text_bytes), url=url),
    )
