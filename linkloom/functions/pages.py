"""Expressions that read a page's structure off its array of elements."""

from __future__ import annotations

from collections.abc import Callable

from linkloom import fixed_values as fixed
from linkloom.functions.sql import any_of, cases, each, each_numbered, first, first_of_each, keep, let, quote, record
from linkloom.functions.text import head, replace_all, shorten, shorten_at_blank, strip
from linkloom.limits import limits

NO_SECTIONS = "cast(array() AS array<struct<level:tinyint,heading:string,content:string>>)"
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def with_tags(elements: str, *tags: str) -> str:
    return keep(elements, lambda e: f"{e}.tag IN ({', '.join(map(quote, tags))})")


def text_of(element: str, body: str) -> str:
    """Text of an element: its range of the page's bytes."""
    return f"cast(substring({body}, {element}.begin + 1, {element}.stop - {element}.begin) AS string)"


def texts_of(elements: str, record_of: Callable[[str, str], str]) -> str:
    """A record of each element and its text.

    The column `body` is named once: every look at a binary column copies it.
    """
    return let("body", lambda body: each(elements, lambda e: record_of(e, text_of(e, body))))


def _filled(text: str) -> str:
    """Trimmed, with '' as null."""
    return f"nullif({strip(text)}, '')"


def _first_where(elements: str, field: str, test) -> str:
    """Field of the first element that passes, even if the field is empty there."""
    return f"{first(keep(elements, test))}.{field}"


# --- metadata (on the elements of the whole document) ------------------------


def _named(metas: str, attribute: str, key: str) -> str:
    return _filled(_first_where(metas, "content", lambda e: f"{e}.{attribute} = {quote(key)}"))


def meta(metas: str, *keys: str) -> str:
    """First key that is filled; `property` before `name`, of each only the first element counts."""
    tries = [_named(metas, attribute, key) for key in keys for attribute in ("property", "name")]
    return f"coalesce({', '.join(tries)})"


def title(elements: str, metas: str) -> str:
    def of_first(tag: str) -> str:
        return _filled(let(first(keep(elements, lambda e: f"{e}.tag = '{tag}'")), lambda e: text_of(e, "body")))

    return f"coalesce({of_first('title')}, {_named(metas, 'property', 'og:title')}, {of_first('h1')})"


def doi(elements: str, metas: str) -> str:
    identifier = let(
        _named(metas, "name", "DC.identifier"),
        lambda d: f"if(contains({d}, 'doi.org') OR startswith({d}, '10.'), {d}, NULL)",
    )
    link = _first_where(elements, "href", lambda e: f"{e}.tag = 'a' AND contains({e}.href, 'doi.org')")
    return f"coalesce({_named(metas, 'name', 'citation_doi')}, {identifier}, {link})"


# --- content scope -----------------------------------------------------------


def scope(elements: str) -> str:
    """struct<rank, pos, end_pos> of the main content, null if the page names none."""

    def rank(e: str) -> str:
        tests = []
        for number, (kind, name) in enumerate(fixed.SCOPES):
            if kind == "class":
                test = f"array_contains(split(coalesce({e}.class, ''), '\\\\s+'), {quote(name)})"
            else:
                test = f"{e}.{kind} = {quote(name)}"
            tests.append((test, str(number)))
        return cases(tests)

    tags = ", ".join(quote(name) for kind, name in fixed.SCOPES if kind == "tag")
    likely = keep(
        elements,
        lambda e: any_of([f"{e}.tag IN ({tags})", *(f"{e}.{a} IS NOT NULL" for a in ("class", "id", "role"))]),
    )
    ranked = each(likely, lambda e: record(rank=rank(e), pos=f"{e}.pos", end_pos=f"{e}.end_pos"))
    return f"array_min({keep(ranked, lambda s: f'{s}.rank IS NOT NULL')})"


def inside(elements: str, place: str) -> str:
    """Elements of the main content; all of them without one."""
    return let(
        place,
        lambda p: keep(elements, lambda e: f"{p} IS NULL OR {e}.pos BETWEEN {p}.pos AND {p}.end_pos"),
    )


# --- content (on the elements of the scope) ----------------------------------


def long_texts(elements: str, *tags: str) -> str:
    """array<struct<tag, pos, text>> of the tags, trimmed, very short texts left out."""
    picked = texts_of(with_tags(elements, *tags), lambda e, text: record(tag=f"{e}.tag", pos=f"{e}.pos", text=strip(text)))
    return keep(picked, lambda e: f"octet_length({e}.text) >= {fixed.SHORTEST_TEXT}")


def _section(heading: str, paragraphs: str) -> str:
    cut = each(paragraphs, lambda p: shorten_at_blank(f"{p}.text", limits().paragraph_bytes))
    return record(
        level=f"cast(substring({heading}.tag, 2, 1) AS tinyint)",
        heading=shorten_at_blank(f"{heading}.text", limits().heading_bytes),
        content=f"array_join({cut}, '\n\n')",
    )


def _by_tag(headings: str, paragraphs: str) -> str:
    # the greatest heading: by level (in the tag name), then by position
    last = each(f"array(array_max({headings}))", lambda h: _section(h, paragraphs))
    return f"if(size({headings}) > 0 AND size({paragraphs}) > 0, {last}, {NO_SECTIONS})"


def _by_place(headings: str, paragraphs: str) -> str:
    both = f"array_sort(concat({', '.join(each(x, lambda e: record(pos=f'{e}.pos', tag=f'{e}.tag', text=f'{e}.text')) for x in (headings, paragraphs))}))"

    def split(merged: str) -> str:
        """Each heading takes what lies between it and the next one: a slice of the merged list."""
        places = keep(f"sequence(0, size({merged}) - 1)", lambda i: f"coalesce(get({merged}, {i}).tag, 'p') <> 'p'")

        def of_heading(starts: str) -> str:
            def section(at: str, number: str) -> str:
                until = f"coalesce(get({starts}, {number} + 1), size({merged}))"
                following = f"slice({merged}, {at} + 2, {until} - {at} - 1)"
                return let(f"get({merged}, {at})", lambda h: _section(h, following))

            return each_numbered(starts, section)

        return let(places, of_heading)

    return keep(let(both, split), lambda s: f"{s}.content <> ''")


def sections(elements: str, main: str, place: str, order: str = "tag") -> str:
    """array<struct<level, heading, content>>.

    `order="tag"` gives the established result: all headings are visited
    before all paragraphs, so the last heading of the deepest level gets every
    paragraph.  `order="document"` lets each heading keep what follows it.
    """
    build = {"tag": _by_tag, "document": _by_place}[order]
    found = let(
        long_texts(main, *HEADINGS),
        lambda headings: let(long_texts(main, "p"), lambda paragraphs: build(headings, paragraphs)),
    )
    chosen = let(found, lambda s: f"if(size({s}) > 0, {s}, {whole_text_section(elements, place)})")
    return head(chosen, limits().sections_per_page)


def whole_text_section(elements: str, place: str) -> str:
    """One section with the first lines of the rendered text; none for a page without text."""
    width = fixed.FALLBACK_WIDTH
    wrapped = texts_of(
        with_tags(inside(elements, place), "#text"),
        lambda e, text: replace_all(text, rf"(?>(\S{{{width}}}|.{{1,{width}}}(?=\s|\z)))\s*+(?=\S)", "$1\n"),
    )
    lines = f"split(array_join({wrapped}, '\n'), '\n')"
    content = f"array_join({head(lines, limits().fallback_lines)}, '\n')"
    return each(
        keep(f"array({content})", lambda text: f"{text} <> ''"),
        lambda text: record(
            level="cast(1 AS tinyint)",
            heading=quote(fixed.FALLBACK_HEADING),
            content=shorten_at_blank(text, limits().fallback_bytes),
        ),
    )


def links(main: str) -> str:
    """Distinct targets with the text of their first link."""
    usable = keep(
        texts_of(with_tags(main, "a"), lambda e, text: record(text=strip(text), href=f"{e}.href", url=f"{e}.link")),
        lambda e: f"{e}.href <> '' AND NOT startswith({e}.href, '#') AND NOT startswith({e}.href, 'javascript:')"
        f" AND octet_length({e}.text) >= {fixed.SHORTEST_TEXT}",
    )

    def link(found: str) -> str:
        return record(text=let(f"{found}.text", lambda t: shorten(t, limits().link_text_bytes)), url=f"{found}.url")

    return each(head(first_of_each(usable, lambda e: f"{e}.url"), limits().links_per_page), link)


def code_blocks(main: str) -> str:
    """Distinct code: `code` in `pre` first, then any `pre`.

    Under a limit, when the first kind fills it, the second may still add one.
    """
    most = limits().code_per_page

    def usable(kind: str, inner: str) -> str:
        trimmed = texts_of(kind, lambda e, text: record(source=strip(text), classes=f"{e}.class", inner=inner))
        return keep(trimmed, lambda e: f"octet_length({e}.source) >= {fixed.SHORTEST_CODE}")

    def described(block: str) -> str:
        tokens = keep(
            f"split({block}.classes, {quote(f'[{fixed.WS}]+')})",
            lambda t: f"startswith({t}, 'language-') OR startswith({t}, 'lang-')",
        )
        lang = replace_all(first(tokens), r"^(?:language-)*(?:lang-)*", "")
        return record(lang=lang, source=shorten_at_blank(f"{block}.source", limits().code_bytes))

    def by_source(blocks: str) -> str:
        return first_of_each(blocks, lambda e: f"{e}.source")

    def chosen(whole: str, initial: str) -> str:
        more = keep(by_source(f"concat({initial}, {whole})"), lambda e: f"NOT {e}.inner")
        if most is not None:
            more = f"slice({more}, 1, if(size({initial}) = {most}, 1, {most} - size({initial})))"
        return each(f"concat({initial}, {more})", described)

    def of_page(outer: str) -> str:
        # the innermost `pre` around a `code` is in the scope if any is
        in_pre = keep(with_tags(main, "code"), lambda c: f"coalesce({c}.pre >= get({outer}, 0).pos, false)")
        return let(head(by_source(usable(in_pre, "true")), most), lambda initial: chosen(usable(outer, "false"), initial))

    return let(with_tags(main, "pre"), of_page)


def size(found: str) -> str:
    """Bytes of all section headings and contents, 0 without sections."""
    sizes = each(found, lambda s: f"octet_length({s}.heading) + octet_length({s}.content)")
    return f"coalesce(aggregate({sizes}, 0L, (total, n) -> total + n), 0L)"
