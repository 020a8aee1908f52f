"""HTML to an array of elements: the one step that leaves the JVM.

`flatten` reads the tags of one page and reports the few kinds of element the
page operators ask for, and the page's text once: an element has a range of
its bytes, so nested elements repeat no text.  Which of them matter, and what
they say, is decided by Column expressions in `linkloom.operators.pages`.
"""

from __future__ import annotations

import html as entities
import re
import sys
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import accumulate
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom import fixed_values as fixed

# Executors need no copy of this package: the functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FIELDS = ["pos", "end_pos", "tag", "begin", "stop", "pre", "class", "id", "role", "href", "link", "property", "name", "content"]
_NUMBERS = {"pos", "end_pos", "begin", "stop", "pre"}
PAGE = T.StructType(
    [
        T.StructField("body", T.BinaryType()),
        T.StructField(
            "el",
            T.ArrayType(T.StructType([T.StructField(f, T.IntegerType() if f in _NUMBERS else T.StringType()) for f in _FIELDS])),
        ),
    ]
)
_ARROW_PAGE = pa.struct(
    [("body", pa.binary()), ("el", pa.list_(pa.struct([(f, pa.int32() if f in _NUMBERS else pa.string()) for f in _FIELDS])))]
)

_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>|\Z)))?+(?!\s*=)"""
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>?"
    rf"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*+)(?P<end>>|\Z)",
    re.S,
)
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_ATTRIBUTE_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(?:;|(?![=a-zA-Z0-9]))")

# Links that are their own normal form.
_PLAIN_URL = re.compile(r"https?://[a-z0-9.-]+/(?:[A-Za-z0-9_~-]++[.]?/?)*+", re.A)
_PLAIN_ORIGIN = re.compile(r"https?://[a-z0-9.-]+(?=[/?#]|$)")
_PLAIN_PATH = re.compile(r"/(?:[A-Za-z0-9_~,;=&%-]++[.]?/?)*+")

_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT_TAGS = _HEADINGS | {"title", "p", "a", "pre", "code"}  # their text is reported
_SCOPE_TAGS, _SCOPE_CLASSES, _SCOPE_IDS, _SCOPE_ROLES = (
    frozenset(name for kind, name in fixed.SCOPES if kind == wanted) for wanted in ("tag", "class", "id", "role")
)
_RAW_TEXT = {"script", "style", "noscript", "iframe", "noembed", "noframes", "xmp", "textarea", "title"}
_DECODED = {"textarea", "title"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = _HEADINGS | set(  # a start tag of these ends an open paragraph
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure "
    "footer form header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split()
)
_BREAKS = _BLOCKS | {"br", "tr", "td", "th", "body", "title", "option"}
_FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
_SIBLINGS = {  # a start tag on the left ends these, up to an element on the right
    "li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


def resolve(base: str, href: str) -> str:
    """Absolute form of a link; a link that cannot be resolved stays as it is."""
    if _PLAIN_URL.fullmatch(href):
        return href
    if (origin := _PLAIN_ORIGIN.match(base)) and _PLAIN_PATH.fullmatch(href):
        return origin[0] + href
    try:
        scheme, host, path, query, anchor = urlsplit(urljoin(base.strip(), re.sub(r"[\t\n\r]", "", href.strip())))
        if scheme not in ("http", "https"):
            return urlunsplit((scheme, host, path, query, anchor))
        user, at, place = host.rpartition("@")
        place = place.lower().removesuffix({"http": ":80", "https": ":443"}[scheme])
        if not place.isascii():
            place = place.encode("idna").decode("ascii")
        kept = "!$%&'()*+,/:;=@[\\]^|"
        return urlunsplit((
            scheme, user + at + place, quote(path.replace("\\", "/") or "/", safe=kept),
            quote(query, safe=kept + "?`{}"), quote(anchor, safe=kept + "?{}#"),
        ))
    except ValueError:
        return href


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTES.findall(source):
        value = next((v for v in values if v), "")
        if "&" in value:
            value = _ATTRIBUTE_ENTITY.sub(lambda m: entities.unescape(m[0]), value)
        found.setdefault(name.lower(), value)
    return found


def _may_be_scope(attrs: dict[str, str]) -> bool:
    return (
        attrs.get("id") in _SCOPE_IDS
        or attrs.get("role") in _SCOPE_ROLES
        or not _SCOPE_CLASSES.isdisjoint(attrs.get("class", "").split())
    )


def flatten(page: str, base: str) -> tuple[bytes, list[dict]]:
    """Text and elements of a page in document order.

    `pos`..`end_pos` spans an element's inside, `begin`..`stop` its text; `pre` is
    the place of the innermost open `pre` around a `code`.
    """
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    elements: list[dict] = []
    texts: list[str] = []  # all text pieces; an element's text is a range of them
    blocks: list[tuple[int, int]] = []  # (position, first text piece) of each rendered block
    stack: list[list | None] = []  # open: [tag, element or None, first text piece]; None: closed inside
    levels: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
    count = 0

    def close(entry: list) -> None:
        tag, element, first = entry
        if element is not None:
            element["end_pos"] = count
            if tag in _TEXT_TAGS:
                element["pieces"] = first, len(texts)
                if tag == "a":
                    element["link"] = resolve(base, element["href"])

    def close_down_to(level: int) -> None:
        while len(stack) > level or (stack and stack[-1] is None):
            if (entry := stack.pop()) is not None:
                levels[entry[0]].pop()
                close(entry)

    def close_alone(level: int) -> None:
        levels[stack[level][0]].pop()
        close(stack[level])
        stack[level] = None
        close_down_to(len(stack))

    def find(tags: set[str], barrier: set[str]) -> int | None:
        level = max((levels[t][-1] for t in tags if levels[t]), default=-1)
        if level < 0 or any(levels[b] and levels[b][-1] > level for b in barrier):
            return None
        return level

    def say(piece: str, decoded: bool = True) -> None:
        texts.append(entities.unescape(piece) if decoded and "&" in piece else piece)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = _MARKUP.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2].isalpha():  # a tag that never ends is dropped with the rest
                break
            say("<")
            at = lt + 1
            continue
        at = m.end()
        opened, closed = m["open"], m["close"]
        if closed:
            tag = closed.lower()
            level = find(_HEADINGS if tag in _HEADINGS else {tag}, {"table"} if tag != "table" else set())
            if level is None:
                continue
            if tag in _BREAKS:
                blocks.append((count, len(texts)))
            if tag in _FORMATTING:  # ends alone; blocks opened inside it go on
                close_alone(level)
            else:
                close_down_to(level)
        elif opened and m["end"]:
            tag = opened.lower()
            if tag in _BLOCKS and (level := find({"p"}, {"table", "td", "th", "button", "object"})) is not None:
                close_down_to(level)
            if tag in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                close_down_to(len(stack) - 1)
            if tag in _SIBLINGS and (level := find(*_SIBLINGS[tag])) is not None:
                if tag == "a":
                    close_alone(level)
                else:
                    close_down_to(level)
            count += 1
            wanted = m["attrs"] and ("=" in m["attrs"] or "href" in m["attrs"].lower())
            attrs = _attributes(m["attrs"]) if wanted or tag == "a" else {}
            element = None
            if (
                (tag in _TEXT_TAGS and (tag != "a" or "href" in attrs))
                or (tag == "meta" and ("property" in attrs or "name" in attrs))
                or tag in _SCOPE_TAGS
                or attrs and _may_be_scope(attrs)
            ):
                element = {"pos": count, "end_pos": count, "tag": tag, **{k: attrs.get(k) for k in _FIELDS[6:]}}
                if tag == "code" and levels["pre"]:
                    element["pre"] = stack[levels["pre"][-1]][1]["pos"]
                elements.append(element)
            if tag in _BREAKS:
                blocks.append((count, len(texts)))
            if tag in _RAW_TEXT:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
                first = len(texts)
                if end.start() > at:
                    say(page[at : end.start()], tag in _DECODED)
                close([tag, element, first])
                if tag != "textarea" and end.start() > at:
                    blocks.append((-1, first))  # never rendered
                blocks.append((count, len(texts)))
                at = end.end()
            elif tag not in _VOID:
                levels[tag].append(len(stack))
                stack.append([tag, element, len(texts)])
    close_down_to(0)
    coded = [piece.encode() for piece in texts]
    ends = [0, *accumulate(map(len, coded))]
    filled = [0, *accumulate(len(piece.strip()) for piece in texts)]
    for element in elements:
        if "pieces" in element:
            first, last = element.pop("pieces")
            element |= {"begin": ends[first], "stop": ends[last]}
            # Three characters or more besides blanks, or short enough to look.
            room = filled[last] - filled[first]
            element["long"] = room > 2 or room > 0 and len("".join(texts[first:last]).strip().encode()) > 2
    rendered = _rendered(elements, blocks, texts, count)
    for element in rendered:
        if "text" in element:  # other than the page's own bytes
            coded.append(element.pop("text").encode())
            ends.append(ends[-1] + len(coded[-1]))
            element |= {"begin": ends[-2], "stop": ends[-1]}
        else:
            first, last = element.pop("pieces")
            element |= {"begin": ends[first], "stop": ends[last]}
    for element in elements:
        element.pop("long", None)
    return b"".join(coded), elements + rendered


def _rendered(elements: list[dict], blocks: list, texts: list[str], count: int) -> list[dict]:
    """Block texts, one a line, as `#text` elements, if some possible scope has no section of its own.

    There is one element for all blocks between two borders of possible scopes.
    A block that stands alone and is rendered as it is points at the page's own
    bytes, so the body is at most twice the text.
    """
    scopes = [(0, count)] + [
        (e["pos"], e["end_pos"])
        for e in elements
        if e["tag"] in _SCOPE_TAGS or _may_be_scope({k: e[k] for k in ("class", "id", "role") if e[k]})
    ]
    long_enough = [e for e in elements if e.get("long")]
    for kind in (_HEADINGS, {"p"}):
        places = [e["pos"] for e in long_enough if e["tag"] in kind]
        nexts = [bisect_left(places, start) for start, _ in scopes]
        if any(n == len(places) or places[n] > end for n, (_, end) in zip(nexts, scopes)):
            break
    else:
        return []
    blocks = [(0, 0), *blocks, (0, len(texts))]
    borders = sorted({place for start, end in scopes for place in (start, end + 1)})
    runs: list[tuple[int, list]] = []  # neighbouring blocks that every scope has or lacks together
    for (pos, first), (_, until) in zip(blocks, blocks[1:]):
        raw = "".join(texts[first:until]) if pos >= 0 else ""
        if text := " ".join(raw.split()):
            part = bisect_right(borders, pos)
            if not runs or runs[-1][0] != part:
                runs.append((part, []))
            runs[-1][1].append((pos, text, (first, until) if text == raw else None))
    found = []
    for _, run in runs:
        pos, text, pieces = run[0]
        element = {"pos": pos, "end_pos": pos, "tag": "#text"}
        if len(run) == 1 and pieces:
            found.append({**element, "pieces": pieces})
        else:
            found.append({**element, "text": "\n".join(text for _, text, _ in run)})
    return found


@F.arrow_udf(PAGE)
def _elements(url: pa.Array, html: pa.Array) -> pa.Array:
    pages = (
        None if page is None else dict(zip(("body", "el"), flatten(page, base or "")))
        for base, page in zip(url.to_pylist(), html.to_pylist())
    )
    return pa.array(pages, _ARROW_PAGE)


def elements(url: Column, html: Column) -> Column:
    """Text (`body`) and elements (`el`) of a page; relative links are resolved against `url`."""
    return _elements(url, html)
