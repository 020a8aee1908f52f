"""Passages that occur again, by sparse suffixes.

Of every window of LENGTH words the least k-gram is chosen, by its contents
alone; only suffixes that start at such places are kept, about one in twenty.
Two equal windows choose the same place, so a repeated passage of LENGTH words
has suffixes in common at each of its occurrences.

1. Suffixes are brought together by a hash of their first k words.  One without
   an equal there is dropped.
2. A suffix is extended to the left and right by all windows that chose it: a
   block of words.  Equal blocks are counted together, so a group of thousands
   of copies goes on as one.  A block without unequal neighbours is settled.
3. Of the others, one occurrence of each distinct block is read again, and its
   windows are compared one by one with those of its neighbours.
4. Every occurrence gets what was found for its block; windows that follow each
   other make up the passage.

Neighbours in the lexical order of suffixes alone would not do: of three
suffixes a < b < c, a and c may share a passage that reaches far to the left of
the chosen place and only a little to its right, while b, which lies between
them, shares nothing on the left.  So what the order would bring together is
compared by blocks and windows, all of them.

Groups are counts and minima that combine before the shuffle, and joins with
one row per key on one side, which Spark can split; the suffixes of a common
passage never meet in one task.  The result is exact: a word is in a repeated
passage if it lies in a run of LENGTH words that the table holds twice.

Defined results: texts of fewer than LENGTH words, empty and null ones have no
passage; of equal passages the one with the smallest (doc_id, position) is the
first; rows without id are not searched; repeated rows with one id share it,
so that all of them are first; an empty table gives an empty result.  A very
long text is searched whole, some megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.lists import with_values, within
from linkloom.llm.pieces import slices
from linkloom.llm.words import BASE, NOT_BLANK, grams, inside_text, mix, powers, split_words
from linkloom.operators.staging import staged

LENGTH = 50
GRAM = 8

_U = np.uint64
_INVERSE = pow(BASE, -1, 1 << 64)


def _least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` neighbours, the place of the first least one."""
    value, place, reach = hashes, np.arange(len(hashes)), 1
    while reach < width:
        step = min(reach, width - reach)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        place = np.where(right, place[step:], place[:-step])
        reach += step
    return place


def _sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=out[1:])
    return out


def _range_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, wherever they stand."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))


def blocks(texts: pa.Array, length: int, k: int):
    """(text, start, windows, gram, block) of every chosen suffix: its windows begin at start, start + 1, ...; two hashes."""
    words = split_words(texts, NOT_BLANK)
    total = len(words.hash)
    if total < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    hashes = grams(words.hash, k)
    place = _least_places(hashes, length - k + 1)
    valid = np.flatnonzero(inside_text(words.first, length))
    chosen = place[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(valid)))
    start = valid[first]
    inverse = powers(_INVERSE, total + 1)
    block = _range_hash(_sums(words.hash), inverse, start, start + windows - 1 + length)
    text = np.searchsorted(words.first, start, "right") - 1
    return text, start - words.first[text], windows, hashes[chosen[first]].view(np.int64), block.view(np.int64)


SUFFIX = "gram bigint, block bigint, windows int, doc_id bigint, start int"


def suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """One row per kept suffix of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            ids = batch.column(0)
            for texts in slices(batch.column(1)):
                text, start, windows, gram, block = blocks(texts, length, k)
                of = ids.slice(lo, len(texts)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(block), pa.array(windows.astype(np.int32)), of, pa.array(start.astype(np.int32))],
                    names=["gram", "block", "windows", "doc_id", "start"],
                )
                lo += len(texts)

    return docs.mapInArrow(run, SUFFIX)


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """(gram, block, offset, window, n, first_doc, first_start) for each window of the blocks named with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, doc, named in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = split_words(pa.array([text.as_py()], pa.string()), NOT_BLANK)
                sums, inverse = _sums(words.hash), powers(_INVERSE, len(words.hash) + 1)
                counts = np.array([b["windows"] for b in named])
                offset = np.concatenate([np.arange(c) for c in counts])
                start = np.repeat(np.array([b["start"] for b in named]), counts) + offset
                window = _range_hash(sums, inverse, start, start + length).view(np.int64)
                columns = [np.repeat(np.array([b[c] for b in named], np.int64), counts) for c in ("gram", "block", "n")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0]), pa.array(columns[1]), pa.array(offset.astype(np.int32)), pa.array(window),
                        pa.array(columns[2]), pa.array(np.full(len(start), doc)), pa.array(start.astype(np.int32)),
                    ],
                    names=["gram", "block", "offset", "window", "n", "first_doc", "first_start"],
                )

    schema = "gram bigint, block bigint, offset int, window bigint, n bigint, first_doc bigint, first_start int"
    return rows.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(doc_id, start, windows, first_doc, first_start): runs of windows that occur again, and where they occur first."""
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    kept = staged(suffixes(docs, length, k))
    distinct = kept.groupBy("gram", "block", "windows").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    distinct = staged(distinct)
    # Tables with one row per key are written before they are joined, so that Spark can split the other side's hot keys.
    near = distinct.groupBy("gram").agg(F.sum("n").alias("in_all"), F.count("*").alias("unequal")).where("in_all > 1")
    named = staged(distinct.join(staged(near.select("gram", "unequal")), "gram"))

    alike = named.where("unequal = 1").select(
        "gram", "block", F.lit(0).alias("offset"), "windows", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start")
    )
    unlike = named.where("unequal > 1")
    by_doc = unlike.groupBy(F.col("first.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("gram", "block", "windows", "n", F.col("first.start").alias("start"))).alias("named")
    )
    by_doc = staged(by_doc)
    texts = within(docs.select("doc_id", "text"), by_doc).join(by_doc, "doc_id").dropDuplicates(["doc_id"])
    windows = staged(_windows(texts.select("text", "doc_id", "named"), length))
    twice = staged(
        windows.groupBy("gram", "window")
        .agg(F.sum("n").alias("in_all"), F.min(F.struct("first_doc", "first_start")).alias("first"))
        .where("in_all > 1")
    )
    single = windows.select("gram", "window", "block", "offset").join(twice, ["gram", "window"]).select(
        "gram", "block", "offset", F.lit(1).alias("windows"), "first.first_doc", "first.first_start"
    )
    found = alike.unionByName(single).groupBy("gram", "block").agg(
        F.collect_list(F.struct("offset", "windows", "first_doc", "first_start")).alias("runs")  # one per window of a block at most
    )
    rows = kept.select("gram", "block", "doc_id", "start").join(staged(found), ["gram", "block"])
    return rows.select("doc_id", "start", F.explode("runs").alias("r")).select(
        "doc_id", (F.col("start") + F.col("r.offset")).alias("start"), "r.windows", "r.first_doc", "r.first_start"
    )


PASSAGES = "doc_id bigint, passages array<struct<start: int, end: int>>, copies array<struct<start: int, end: int>>"


def passages(docs: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(doc_id, passages, copies) of the documents that have repeated passages: word ranges, and those to drop.

    `copies` has the words of windows that occurred before; the first
    occurrence of a passage is in `passages` only.
    """
    runs = repeated_runs(docs, length, k)
    later = F.when((F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start")), 0).otherwise(1)
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", later.alias("later"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            whole, copies = [], []
            for runs in batch.column(1).to_pylist():
                start = np.array([r["start"] for r in runs])
                end = start + np.array([r["windows"] for r in runs]) - 1 + length
                later = np.array([r["later"] for r in runs], bool)
                whole.append(_union(start, end))
                copies.append(_union(start[later], end[later]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, kind), pa.array(copies, kind)], names=["doc_id", "passages", "copies"])

    return by_doc.mapInArrow(run, PASSAGES)


def _union(start: np.ndarray, end: np.ndarray) -> list[dict]:
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1
    return [{"start": s, "end": e} for s, e in zip(start[new].tolist(), end[last].tolist())]


def without_copies(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the words of later copies cut out; documents of which nothing is left go."""
    columns = docs.columns
    at = columns.index(text)
    joined = with_values(docs, found.where(F.size("copies") > 0).select("doc_id", F.col("copies").alias("__copies")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(len(columns)).to_pylist()
            texts = batch.column(at).to_pylist()
            keep = []
            for i, ranges in enumerate(copies):
                if ranges and texts[i] is not None:
                    texts[i] = _cut(texts[i], ranges)
                keep.append(not ranges or texts[i] is None or bool(texts[i]))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def _cut(text: str, ranges: list[dict]) -> str:
    words = split_words(pa.array([text], pa.string()), NOT_BLANK)
    body = words.data.tobytes()
    kept, at = [], 0
    for r in ranges:
        if r["end"] > len(words.start):
            continue  # the ranges of another text with the same id
        kept.append(body[at : words.start[r["start"]]])
        at = words.start[r["end"]] if r["end"] < len(words.start) else words.end[-1]
    kept.append(body[at:])
    left = b"".join(kept)
    return left.decode() if left.strip(b" \t\n\v\f\r") else ""
