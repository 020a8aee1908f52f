"""Importance resampling towards the distribution of a target corpus.

Documents and target texts become bags of hashed word runs.  A bucket's gain is
the log ratio of its smoothed shares in target and corpus, a document's weight
the mean gain of its features, and documents are drawn without replacement by
weight plus Gumbel noise that their id decides.

Hashing follows prefixes: a text's words, lower-cased, are joined by one blank
and read once, with the running CRC kept at every word's end.  The CRC of a run
of words follows from the running ones before and behind it: the former is
shifted over GF(2) by the run's length in bytes and cancelled from the latter.
So no run is ever put together or read again, whatever the number of words.

Corpus statistics are 10,000 counts, summed per task and then by Spark.  Texts
are read twice, and only numbers leave the second pass.  Ranks come from a range
partitioned sort of these numbers and one count per share of it.

Defined results: a null text has no words, no features and weight 0; so has one
without words.  A very long text is read piece by piece and never put into
features as text.  Repeated rows, and rows without doc_id, are drawn each for
itself, in an order that the written scores fix; a null doc_id counts as '' in
the noise and comes last among ties.  With an empty target or corpus the
smoothing decides alone.  An empty table gives an empty one.  Only the columns
named below are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.pieces import slices
from linkloom.llm.words import ALNUM, spread_ranges, text_bytes
from linkloom.operators.staging import staged

MOST_WORDS = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SLICE = 2 << 20
SHORT = 64

_U = np.uint32
_POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))


def _byte_tables(operator: list[int]) -> np.ndarray:
    """A linear map of 32 bits, given by the images of its bits, as a table for each of the four bytes."""
    tables = np.zeros((4, 256), _U)
    for byte in range(4):
        for bit in range(8):
            tables[byte, np.arange(256) >> bit & 1 == 1] ^= _U(operator[8 * byte + bit])
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _shifts(doublings: int) -> list[np.ndarray]:
    """Tables that move a CRC on by 1, 2, 4, ... zero bytes."""
    step = np.array([1 << bit for bit in range(32)], _U)
    for _ in range(8):
        step = (step >> _U(1)) ^ (step & _U(1)) * _U(_POLYNOMIAL)
    found = []
    for _ in range(doublings):
        tables = _byte_tables(step.tolist())
        found.append(tables)
        step = _apply(tables, step)
    return found


_SHIFTS = _shifts(31)


def _short_shifts() -> np.ndarray:
    """[byte, number of bytes, value]: what each byte of a CRC becomes when moved on by up to SHORT bytes."""
    found = np.zeros((4, SHORT, 256), _U)
    found[:, 0] = np.arange(256, dtype=_U) << (8 * np.arange(4, dtype=_U))[:, None]
    for n in range(1, SHORT):
        found[:, n] = _apply(_SHIFTS[0], found[:, n - 1])
    return found.reshape(4, -1)


_SHORT = _short_shifts()


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of bytes: the part that a prefix has in the CRC of what is `by` bytes longer.

    Multiples of SHORT bytes go by doublings, which only very long words need; the rest by one look into a table.
    """
    out, far = crc, by // SHORT * SHORT
    if far.any():
        out = crc.copy()
        for k, tables in enumerate(_SHIFTS):
            chosen = np.flatnonzero(far >> k & 1)
            if len(chosen):
                out[chosen] = _apply(tables, out[chosen])
    row = (by - far).astype(np.int64) << 8
    return (
        _SHORT[0][row + (out & 255)] ^ _SHORT[1][row + (out >> 8 & 255)]
        ^ _SHORT[2][row + (out >> 16 & 255)] ^ _SHORT[3][row + (out >> 24)]
    )


def substring_crc(before: np.ndarray, behind: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of substrings from the running CRCs before and behind them."""
    return behind ^ shifted(before, size)


class Runs:
    """Words of some texts: running CRCs of the joined words, and offsets.

    Text d has words first[d] to first[d + 1].  Word w begins at `begin[w]` of
    the joined text, where the CRC is `before[w]`, and ends at `end[w]`, `behind[w]`.
    """

    def __init__(self, texts: pa.Array):
        data, at = text_bytes(texts)
        inside = np.concatenate([[False], ALNUM[data], [False]])
        begins = inside[1:-1] & ~inside[:-2]
        seams = at[(at > 0) & (at < len(data))]
        begins[seams] = inside[1:-1][seams]
        start = np.flatnonzero(begins)
        stops = inside[1:-1] & ~inside[2:]
        stops[seams - 1] = inside[1:-1][seams - 1]
        size = np.flatnonzero(stops) + 1 - start
        self.first = np.searchsorted(start, at)
        opening = np.zeros(len(start), bool)
        opening[self.first[:-1][np.diff(self.first) > 0]] = True
        # every word but a text's first is read with the one blank before it
        plain = data.tobytes().translate(_PLAIN)
        pieces = [plain[a:b] for a, b in zip((start - ~opening).tolist(), (start + size).tolist())]
        running = []
        for a, b in zip(self.first.tolist(), self.first[1:].tolist()):
            if b > a:
                running += accumulate(pieces[a + 1 : b], lambda crc, word: crc32(word, crc), initial=crc32(pieces[a]))
        self.behind = np.array(running, _U)
        ends = np.cumsum(size + 1)
        of_text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        base = np.concatenate([[0], ends])[self.first]
        self.end = ends - 1 - base[of_text]
        self.begin = self.end - size
        previous = np.concatenate([np.zeros(min(1, len(start)), _U), self.behind[:-1]])
        blank = ~shifted_by_byte(~previous, 32)
        self.before = np.where(opening, _U(0), blank)

    def buckets(self, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all runs of 1 to `most_words` words, text by text, and how many each text has."""
        n_words = np.diff(self.first)
        found, owners = [], []
        for n in range(1, most_words + 1):
            runs = np.maximum(n_words - n + 1, 0)
            lo = spread_ranges(self.first[:-1], runs)
            hi = lo + n - 1
            crc = substring_crc(self.before[lo], self.behind[hi], self.end[hi] - self.begin[lo])
            found.append((crc % _U(buckets)).astype(np.int64))
            owners.append(np.repeat(np.arange(len(n_words)), runs))
        return np.concatenate(found), np.concatenate(owners)


_ONE = _byte_tables([int(x) for x in _apply(_SHIFTS[0], np.array([1 << b for b in range(32)], _U))])


def shifted_by_byte(register: np.ndarray, byte: int) -> np.ndarray:
    """The CRC register after one more byte."""
    return _apply(_ONE, register ^ _U(byte))


def _counts(texts: DataFrame, text: str, most_words: int, buckets: int) -> list[int]:
    """Features of all texts by bucket: one row of sums per task, then one per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                total += np.bincount(Runs(part).buckets(most_words, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = [0] * buckets
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Floored log ratio, in thousandths, of each bucket's smoothed shares in target and corpus."""
    n, s_all, t_all = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus, target)]


def weights(
    docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    held = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in slices(batch.column(1), SLICE):
                runs = Runs(part)
                found, owner = runs.buckets(most_words, len(held))
                n = np.bincount(owner, minlength=len(part))
                total = np.bincount(owner, held[found], len(part)).astype(np.int64)  # whole numbers, exact in doubles
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array(np.diff(runs.first)), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )
                lo += len(part)

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def noise(seed: int) -> str:
    """SQL: Gumbel noise in thousandths, floored, by the document's id."""
    h = f"conv(substring(sha2(concat('{seed}:', coalesce(cast(doc_id AS string), '')), 256), 1, 8), 16, 10)"
    return f"cast(floor(-1000 * ln(-ln((cast({h} AS double) + 0.5D) / 4294967296D))) AS bigint)"


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Add `rank`: 1, 2, ... over the drawn ones of the documents with enough words, null for all others."""
    scored = scored.withColumn("__in", F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id())
    order = [F.desc("__in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")]
    held = staged(scored)  # a lost executor must not number rows anew
    sorted_rows = staged(held.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__share", F.spark_partition_id()))
    shares = sorted_rows.groupBy("__share").agg(F.count("*").alias("n"), F.count_if("__in").alias("n_in"))
    before = Window.orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)  # a row per share
    whole = Window.orderBy("__share").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = shares.select(
        "__share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"),
        F.floor(F.sum("n_in").over(whole) * percent / 100).alias("__drawn"),
    )
    place = F.row_number().over(Window.partitionBy("__share").orderBy(*order)) + F.col("__start")
    rows = sorted_rows.join(F.broadcast(starts), "__share").withColumn("__place", place.cast("bigint"))
    return rows.withColumn("rank", F.when(F.col("__in") & (F.col("__place") <= F.col("__drawn")), F.col("__place")))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
    seed: int = SEED, most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; those with a rank are drawn."""
    gain = gains(_counts(docs, text, most_words, buckets), _counts(target, text, most_words, buckets))
    scored = weights(docs, gain, doc_id, text, most_words)
    scored = scored.withColumn("score", F.col("weight") + F.expr(noise(seed)))
    return ranked(scored, least_words, percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
