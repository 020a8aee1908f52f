"""Paper texts to structured records: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linkloom import fixed_values as fixed
from linkloom.functions import papers as paper
from linkloom.functions.sql import cases, quote
from linkloom.functions.text import lines
from linkloom.functions.pages import size


def extract(docs: DataFrame) -> DataFrame:
    """Records shaped like those of pages: (url, status, title, ..., alerts, chars).

    A text that is missing, failed or empty gives a dead record with a note;
    a blank one is fine but has no sections.
    """
    failed = f"concat({quote(fixed.NO_EXTRACTION)}, error)" if "error" in docs.columns else "NULL"
    trouble = cases(
        [
            ("text IS NULL", f"coalesce({failed}, {quote(fixed.NO_FILE)})"),
            ("text = ''", quote(fixed.NO_TEXT)),
        ],
        "cast(NULL AS string)",
    )
    judged = docs.selectExpr(
        "path", f"{trouble} AS trouble", "nullif(text, '') AS text", f"{lines("nullif(text, '')")} AS raw_lines"
    )
    fields = judged.selectExpr(
        "concat('file://', path) AS url",
        "if(trouble IS NULL, 'ok', 'dead') AS status",
        f"if(trouble IS NULL, {paper.title('raw_lines', 'path')}, NULL) AS title",
        "cast(NULL AS string) AS site",
        f"{paper.author('text')} AS author",
        f"{paper.date('text')} AS date",
        f"{paper.doi('text')} AS doi",
        f"{paper.sections('raw_lines')} AS sections",
        f"{paper.links('text')} AS links",
        f"{paper.code_islands('raw_lines')} AS code",
        "array_compact(array(trouble)) AS alerts",
    )
    return fields.selectExpr("*", f"{size('sections')} AS chars")
