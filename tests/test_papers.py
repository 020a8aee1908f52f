"""Whole paper records."""

import time
from random import Random

from linkloom.functions import papers as paper
from linkloom.functions.text import lines
from linkloom.limits import WHOLE, using
from linkloom.operators import papers, rollups

LONG = "some words that fill up a line of text well beyond fifty bytes"


def _sections(value, text):
    return [tuple(s) for s in value(paper.sections(lines("t")), t=text)]


def _code(value, text):
    return [tuple(c) for c in value(paper.code_islands(lines("t")), t=text)]


def test_heading_opens_a_section_only_after_fifty_bytes(value):
    got = _sections(value, f"TITLE LINE\nshort\n{LONG}\n\n\n2.1 RESULTS HERE\n\nfirst\nsecond\n\nthird\n")
    assert got == [
        (1, "Content", f"TITLE LINE short {LONG}"),
        (2, "2.1 RESULTS HERE", "first second\n\nthird"),
    ]


def test_exactly_fifty_bytes_do_not_open_a_section(value):
    assert len(_sections(value, "x" * 50 + "\nHEADING\nmore")) == 1
    assert len(_sections(value, "x" * 51 + "\nHEADING\nmore")) == 2
    assert len(_sections(value, "é" * 25 + "\nHEADING\nmore")) == 1  # bytes, not characters
    assert len(_sections(value, "é" * 26 + "\nHEADING\nmore")) == 2
    assert len(_sections(value, "x" * 49 + "\n\nHEADING\nmore")) == 2  # a blank line counts two


def test_last_heading_without_content_is_dropped(value):
    assert _sections(value, f"{LONG}\nHEADING") == [(1, "Content", LONG)]
    assert _sections(value, " \n\t\n") == []


def test_line_ends_of_either_kind(value):
    assert _sections(value, "a\r\nb\n\r\nc") == [(1, "Content", "a b\n\nc")]


def test_section_caps(value):
    many = "\n".join(f"{LONG}\nHEADING {'ABCDEFGHIJ'[n % 10]}" for n in range(130)) + f"\n{LONG}"
    assert len(_sections(value, many)) == 100
    (one,) = _sections(value, "y" * 12000)
    assert len(one[2]) == 10000 and one[2].endswith("y...")


def test_code_needs_three_lines_and_twenty_bytes(value):
    assert _code(value, "text\n    one line here\n    two line here\ntext") == []
    assert _code(value, "    a\n    b\n    c") == []  # seventeen bytes
    assert _code(value, "    aa\n    bb\n    cc\nx") == [(None, "    aa\n    bb\n    cc")]
    assert _code(value, "see http://x.org\nimport it now\n\tindented\nend") == [
        (None, "see http://x.org\nimport it now\n\tindented")
    ]


def test_code_runs_split_at_plain_lines_and_stop_at_ten(value):
    block = "    def f(x):\n    return x\n    # done"
    got = _code(value, "\nplain\n".join([block] * 13))
    assert got == [("python", block)] * 10


def test_records(spark):
    docs = spark.createDataFrame(
        [
            ("in/one.v1.pdf", f"Hi\n{LONG}", None), ("in/two.pdf", "", None), ("in/three.pdf", None, None),
            ("in/four.pdf", None, "bad xref"), (".hidden", "  \n", None),
        ],
        "path string, text string, error string",
    )
    rows = {r.url: r for r in papers.extract(docs).collect()}
    one = rows["file://in/one.v1.pdf"]
    assert (one.status, one.title, one.chars) == ("ok", "one.v1", len("Content" + f"Hi {LONG}"))
    assert (rows["file://in/two.pdf"].status, rows["file://in/two.pdf"].alerts) == ("dead", ["PDF contains no extractable text"])
    assert rows["file://in/three.pdf"].alerts == ["File not found"]
    assert rows["file://in/four.pdf"].alerts == ["PDF extraction failed: bad xref"]
    blank = rows["file://.hidden"]
    assert (blank.status, blank.title, blank.sections, blank.chars) == ("ok", ".hidden", [], 0)
    assert tuple(rollups.record_totals(papers.extract(docs)).first()) == (2, 5)


def _plain_starts(lines):
    """Indexes of opening lines, line by line."""
    starts, held, glued = [], 0, True
    for i, line in enumerate(lines):
        if not line:
            held, glued = held + 2 if held else 0, True
        elif line.isupper() and len(line.encode()) > 3 and held > 50:
            starts.append(i)
            held, glued = 0, True
        else:
            held, glued = held + len(line.encode()) + (0 if glued else 1), False
    return starts


def test_sections_open_where_a_line_by_line_walk_opens_them(spark):
    random = Random(4)
    kinds = ["", "", "HEADING", "NEXT ONE", "short", "x" * 20, "x" * 24, "x" * 49, "x" * 50, "x" * 51, "é" * 25, LONG]
    texts = [[random.choice(kinds) for _ in range(random.randrange(1, 40))] for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t array<string>")
    got = rows.selectExpr("id", f"{paper.section_starts('t')} AS s").orderBy("id").collect()
    assert [r.s for r in got] == [_plain_starts(t) for t in texts]
    assert sum(len(r.s) for r in got) > 300


def test_a_hundred_thousand_headings_take_linear_time(spark):
    def seconds(n):
        text = f"{LONG}\nHEADING HERE\n" * n + LONG
        rows = spark.createDataFrame([(text,)], "t string")
        begin = time.perf_counter()
        with using(WHOLE):
            (r,) = rows.selectExpr(f"size({paper.sections(lines('t'))}) AS n").collect()
        assert r.n == n + 1
        return time.perf_counter() - begin

    seconds(2_000)
    half, whole = min(seconds(50_000) for _ in range(2)), min(seconds(100_000) for _ in range(2))
    assert whole < 3 * half + 1
