"""Benchmark decontamination by winnowing.

Of every `window - k + 1` neighbouring k-grams the least hash is kept, in
benchmark items and in texts alike.  So a run of `window` equal words leaves
an equal fingerprint on both sides, without exception.  Fingerprints of texts
that a benchmark item also has are extended: each run of `window` words around
one is compared with the item's runs, and the words of all equal runs are hit.

The benchmark goes to the tasks in blocks of bounded size, one pass over the
texts for each block, so no text is shuffled and any benchmark will do.

Defined results: a null or wordless text has no words and no hits; an item
without words occurs nowhere; an item shorter than a window is one run, looked
up at every word; repeated items and texts count one by one; empty tables give
no hits; other columns of the texts are not kept.  A very long text is searched
whole, about a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import ALNUM, grams, inside_text, run_hashes, split_words, spread_ranges

WINDOW = 13
GRAM = 5
BLOCK_BYTES = 8 << 20


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    low, reach = hashes, 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return low


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is the least of one of the windows that hold it."""
    if len(hashes) < width:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.zeros(0, np.int64)
    least = window_minima(hashes, width)
    # A position is kept if the greatest of its windows' minima is its own hash.
    greatest = ~window_minima(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    return np.flatnonzero(greatest == hashes)


class Block:
    """Fingerprints and runs of some benchmark items."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW, k: int = GRAM):
        self.window, self.k = window, k
        words = split_words(pa.array(texts, pa.string()), ALNUM, fold=True)
        sizes = np.diff(words.first)
        owner = words.of_word()
        long_run = np.flatnonzero(inside_text(words.first, window)) if len(words.hash) >= window else np.zeros(0, np.int64)
        keys = [run_hashes(words.hash, long_run, window)]
        items = [owner[long_run]]
        self.short = {}
        for size in sorted(set(sizes[(sizes > 0) & (sizes < window)].tolist())):
            which = np.flatnonzero(sizes == size)
            hashes = run_hashes(words.hash, words.first[which], size)
            order = np.argsort(hashes, kind="stable")
            self.short[size] = hashes[order], which[order]
        key, item = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(key, kind="stable")
        self.runs, self.run_items = key[order], item[order]
        kept = np.zeros(0, np.uint64)
        if len(long_run):
            fingerprints = grams(words.hash, k)
            parts = [fingerprints[a : b - k + 1] for a, b in zip(words.first[:-1], words.first[1:]) if b - a >= window]
            kept = np.unique(np.concatenate([p[winnowed(p, window - k + 1)] for p in parts]))
        self.fingerprints = kept
        self.ids = ids

    def hits(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equal runs: first word, length, and number of the item."""
        found = []
        total = len(words.hash)
        if len(self.fingerprints) and total >= self.window:
            reach = self.window - self.k
            hashes = grams(words.hash, self.k)
            marks = winnowed(hashes, reach + 1)
            marks = marks[_among(hashes[marks], self.fingerprints)]
            around = np.unique(spread_ranges(marks - reach, np.full(len(marks), reach + 1)))
            around = around[(around >= 0) & (around <= total - self.window)]
            around = around[inside_text(words.first, self.window)[around]]
            found.append(self._equal(words, around, self.window, self.runs, self.run_items))
        for size, (keys, items) in self.short.items():
            if total >= size:
                hashes = grams(words.hash, size)
                at = np.flatnonzero(inside_text(words.first, size) & _among(hashes, keys))
                found.append(self._equal(words, at, size, keys, items))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def _equal(words, at: np.ndarray, size: int, keys: np.ndarray, items: np.ndarray):
        hashes = run_hashes(words.hash, at, size)
        lo, hi = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        n = hi - lo
        return np.repeat(at, n), np.full(int(n.sum()), size), items[spread_ranges(lo, n)]


def _among(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes are among sorted keys."""
    if not len(keys):
        return np.zeros(len(hashes), bool)
    return keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Rows of the benchmark, in lists of about `block_bytes` at most, streamed one partition at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        rows.append(row)
        size += len(row[1] or "") + 16
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


HITS = "doc_id bigint, n_words bigint, hits array<struct<start: int, end: int>>, items array<string>"
_ARROW = {
    "hits": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    "items": pa.list_(pa.string()),
}


def _pass(docs: DataFrame, block: Block, last: bool) -> DataFrame:
    """Add one block's hits and items to those of the blocks before."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    first = "hits" not in docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = np.array([str(x) for x in block.ids], dtype=object)
        for batch in batches:
            n = batch.num_rows
            words = split_words(batch.column(1), ALNUM, fold=True)
            start, size, item = block.hits(words)
            owner = np.searchsorted(words.first, start, "right") - 1
            found = [start - words.first[owner], start + size - words.first[owner], owner]
            spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
            if not first:
                held = batch.column(3).to_pylist()
                before = [(x["start"], x["end"], d) for d, xs in enumerate(held) for x in xs]
                found = [np.concatenate([f, np.array(b, np.int64)]) for f, b in zip(found, zip(*before))] if before else found
                items = batch.column(4).to_pylist()
            begin, end, owner_of = found
            order = np.lexsort((begin, owner_of))
            for d, s, e in merged(owner_of[order], begin[order], end[order]):
                spans[d].append({"start": s, "end": e})
            pairs = np.unique(np.stack([owner, item], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
            for d, i in pairs.tolist():
                items[d].append(names[i])
            columns = [batch.column(0), pa.array(np.diff(words.first)), pa.array(spans, _ARROW["hits"]), pa.array(items, _ARROW["items"])]
            names_out = ["doc_id", "n_words", "hits", "items"]
            if not last:
                columns.insert(1, batch.column(1))
                names_out.insert(1, "text")
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return docs.mapInArrow(scan, HITS if last else HITS.replace("doc_id bigint", "doc_id bigint, text string"))


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Unions of ranges sorted by owner and start."""
    if not len(owner):
        return
    shift = owner * (int(end.max()) + 1)  # owners' ranges in a row, so one running maximum will do
    last = np.maximum.accumulate(end + shift) - shift
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > last[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(owner)) - 1
    yield from zip(owner[at].tolist(), start[at].tolist(), last[stop].tolist())


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, hits, items): word ranges hit by the benchmark, and the items they come from, as sorted text."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rest = blocks_of(benchmark, item_id, item_text, block_bytes)
    rows = next(rest, [])
    while rows is not None:
        following = next(rest, None)
        texts = _pass(texts, Block([r[0] for r in rows], [r[1] for r in rows]), last=following is None)
        rows = following
    return texts.withColumn("items", F.array_sort(F.array_distinct("items")))


def judged(found: DataFrame, percent: int = 5) -> DataFrame:
    """Add `n_hit` and `contaminated`: at least `percent` of the words, and one, are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda sum, x: sum + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    )
