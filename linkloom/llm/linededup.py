"""Lines that many documents share: boilerplate stays in one document only.

Every line is normalised and hashed; lines whose normal form is long enough
and stands in enough documents are dropped from all documents but one, and the
other lines are put together again by their position.  All of it are SQL
expressions, joins and aggregates.

What is shuffled are numbers: two hashes of a line, its document's hashes and
its position.  A line is counted once per document where it is read, and counts
combine map-side, so a line of a third of all documents sends one row per task.
To find the places of common lines, those that hold more than a thousandth of
all places (a thousand lines at most) are sent to every task; the others meet
their places in a join, where no key has more than that share.  Texts are
shuffled only if a filter of fixed size says that they may lose lines.

Defined results: a null text counts as one empty line and stays null; a text
that loses all lines becomes empty; a very long text is one row throughout, and
its lines are sorted, never compared with each other.  Rows are documents:
those that repeat one doc_id count one each, and if they have the greatest
doc_id of a line, all of them keep it.  A null doc_id is less than any other.
An empty table gives an empty one.  Other columns stay, but for those named
`kept_text`, `n_lines` and `n_dropped`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.sql import each, each_numbered, keep, let, quote, record
from linkloom.llm.urlfilter import bloom, may_be_listed
from linkloom.operators.staging import staged
from linkloom.operators.unfold import unfold

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
HOT_LINES = 1000
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: str) -> str:
    """SQL: lines of a text, one empty line for null."""
    return f"split(coalesce({text}, ''), '\\n')"


def normal(line: str) -> str:
    """SQL: a line without blanks at its ends, A-Z lower-cased."""
    return f"translate(btrim({line}, {quote(BLANKS)}), '{CAPITALS}', '{CAPITALS.lower()}')"


def _row_hashes(doc_id: str, text: str) -> list[str]:
    """SQL: two hashes that name a row by its id and text."""
    given = f"isnull({doc_id}), {doc_id}, isnull({text}), {text}"
    return [f"xxhash64({given}) AS __r1", f"xxhash64('row', {given}) AS __r2"]


def _marks(text: str, least_chars: int) -> str:
    """SQL: array<struct<k1, k2, pos, is_first>> of the long lines; `is_first` is raised once per distinct line."""
    keys = each_numbered(lines_of(text), lambda line, i: let(normal(line), lambda key: record(
        k1=f"if(char_length({key}) >= {least_chars}, xxhash64({key}), NULL)", k2=f"xxhash64('line', {key})", pos=i)))
    ordered = f"array_sort({keep(keys, lambda x: f'{x}.k1 IS NOT NULL')})"

    def flagged(rows: str) -> str:
        def one(x: str, i: str) -> str:
            before = f"get({rows}, {i} - 1)"
            return record(k1=f"{x}.k1", k2=f"{x}.k2", pos=f"{x}.pos",
                          is_first=f"{i} = 0 OR {before}.k1 <> {x}.k1 OR {before}.k2 <> {x}.k2")

        return each_numbered(rows, one)

    return let(ordered, flagged)


def common_lines(marks: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(k1, k2, keeper, n): lines of enough documents, the greatest doc_id that has them, and how many places they hold."""
    counted = marks.groupBy("k1", "k2").agg(
        F.count_if("is_first").alias("documents"), F.max("doc_id").alias("keeper"), F.count("*").alias("n")
    )
    return counted.where(F.col("documents") >= least_documents).drop("documents")


def _places(marks: DataFrame, common: DataFrame) -> DataFrame:
    """Marks of common lines with their keeper."""
    bound = marks.count() // HOT_LINES
    hot, rest = common.where(F.col("n") > bound), common.where(F.col("n") <= bound)
    key = ["k1", "k2"]
    in_hot = marks.join(F.broadcast(hot), key)
    in_rest = marks.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return in_hot.unionByName(in_rest)


def drop_common_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """All columns of `docs`, `kept_text`, `n_lines` (before) and `n_dropped`."""
    made = ("kept_text", "n_lines", "n_dropped")
    columns = [c for c in docs.columns if c.lower() not in made]
    doc_id, text = f"__doc.`{doc_id}`", f"__doc.`{text}`"
    # the given columns travel in one, so that none of their names is in the way
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__doc")).selectExpr("__doc", *_row_hashes(doc_id, text))
    marks = staged(
        unfold(rows, [f"{doc_id} AS doc_id", "__r1", "__r2"], _marks(text, least_chars), "line")
        .select("doc_id", "__r1", "__r2", "line.*")
    )
    common = staged(common_lines(marks, least_documents))
    lost = _places(marks, common).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = staged(lost.groupBy("__r1", "__r2").agg(F.collect_set("pos").alias("__lost")))
    probed = may_be_listed(rows, "__r1", bloom(lost, "__r1"))
    some = probed.where("__maybe").join(lost, ["__r1", "__r2"], "left").select("__doc", "__lost")
    rest = probed.where("NOT __maybe").select("__doc", F.lit(None).cast("array<int>").alias("__lost"))
    kept = let(lines_of(text), lambda lines: f"array_join({each(
        f'array_except(sequence(0, size({lines}) - 1), __lost)', lambda at: f'get({lines}, {at})')}, '\n')")
    return some.unionByName(rest).selectExpr(
        "__doc.*",
        f"if(__lost IS NULL OR {text} IS NULL, {text}, {kept}) AS kept_text",
        f"cast(size({lines_of(text)}) AS bigint) AS n_lines",
        "cast(coalesce(size(__lost), 0) AS bigint) AS n_dropped",
    )
