"""Toxicity: bags of subwords, averaged and put through a linear softmax.

A word is the average of the vectors of its character n-grams, with marks at
both ends, so a misspelt or newly coined word shares vectors with words that
were seen.  A passage is the average of some neighbouring words, and a text is
judged by its passages, pooled by a soft maximum: a few words in a long text
are not averaged away.  Vectors and softmax are trained jointly, in numpy, by
full-batch descent on a sample of labelled documents whose size is bounded by
`per_class`.  With two classes the softmax needs the difference of the logits
only.

Scoring needs one table with a number per n-gram bucket, of a fixed size.

Defined results: a text without words (null, empty) scores 0; without labelled
texts of both classes every text with words gets the share of toxic ones among
the labels (0 without labels); a document labelled twice counts as toxic if
one label says so; repeated rows get equal scores; an empty table gives an
empty one; null labels and labels without document are ignored.  A very long text
is cut into words whole, whatever its length.  A column named `score`, in any
letters, is replaced.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.pieces import slices
from linkloom.llm.words import ALNUM, BASE, Words, mix, numbered, split_words, spread_ranges

LENGTHS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 8
PASSAGE = 8
PER_CLASS = 2500
LEAST = 5
SLICE = 2 << 20
PART = 1 << 20
WORDS = 50_000

_U = np.uint64
_LETTERS = numbered(256, 11)
_LETTERS[65:91] = _LETTERS[97:123]
_BEGIN, _END = ord("<"), ord(">")  # no letters, so no word has them inside


def subwords(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the chosen words, word by word, and how many each has."""
    sizes = (words.end - words.start)[chosen]
    total = int(sizes.sum()) + 2 * len(chosen)
    body = np.full(total, _BEGIN, np.uint8)
    first = np.cumsum(sizes + 2) - (sizes + 2)
    last = first + sizes + 1
    body[last] = _END
    body[spread_ranges(first + 1, sizes)] = words.data[spread_ranges(words.start[chosen], sizes)]
    letters = _LETTERS[body]
    owner = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes + 2)
    room = last[owner] - np.arange(total) + 1  # letters from here to the word's end
    buckets, owners = [], []
    rolling = letters.copy()
    for n in range(2, max(LENGTHS) + 1):
        rolling = rolling[:-1] * _U(BASE) + letters[n - 1 :] if len(rolling) > 1 else rolling[:0]
        if n in LENGTHS:
            at = np.flatnonzero(room[: len(rolling)] >= n)
            buckets.append((mix(rolling[at] + _U(n)) & _U(BUCKETS - 1)).astype(np.int32))
            owners.append(owner[at])
    bucket, of = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.bincount(of, minlength=len(chosen))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among sorted ones."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each run of `counts` values; 0 for an empty run."""
    ends = np.cumsum(counts)
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


@dataclass
class Passages:
    """Distinct words with their buckets; the word of each token; tokens per passage; passages per text."""

    buckets: np.ndarray
    per_word: np.ndarray
    token: np.ndarray
    per_passage: np.ndarray
    per_text: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Passages:
        hashes, buckets, per_word, token, sizes = [], [], [], [], []
        seen = np.zeros(0, _U)
        for part in slices(texts, SLICE) if len(texts) else [texts]:  # splitting takes many times the size of the text
            words = split_words(part, ALNUM, fold=True)
            found, chosen, place = np.unique(words.hash, return_index=True, return_inverse=True)
            new = ~_among(found, seen)
            bucket, n = subwords(words, chosen[new])
            hashes.append(found[new])
            buckets.append(bucket)
            per_word.append(n)
            token.append((found, place.reshape(-1).astype(np.int32)))
            sizes.append(np.diff(words.first))
            seen = np.sort(np.concatenate([seen, found[new]]))
        del words
        # words in the order of their hashes, so that nothing depends on slices
        order = np.argsort(np.concatenate(hashes))
        token = np.concatenate([np.searchsorted(seen, found).astype(np.int32)[place] for found, place in token])
        sizes, per_word, held = np.concatenate(sizes), np.concatenate(per_word), np.concatenate(buckets)
        del buckets, hashes
        starts, buckets = (np.cumsum(per_word) - per_word)[order], np.empty(len(held), np.int32)
        per_word, at = per_word[order], 0
        for lo in range(0, len(order), WORDS):
            part = slice(lo, lo + WORDS)
            moved = held[spread_ranges(starts[part], per_word[part])]
            buckets[at : at + len(moved)] = moved
            at += len(moved)
        del held
        per_text = -(-sizes // PASSAGE)
        per_passage = np.full(int(per_text.sum()), PASSAGE, np.int64)
        full = np.cumsum(per_text)[sizes > 0] - 1
        per_passage[full] = sizes[sizes > 0] - PASSAGE * (per_text[sizes > 0] - 1)
        return cls(buckets, per_word, token, per_passage, per_text)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Logit of each passage, without bias."""
        return _means(_means(weights[self.buckets], self.per_word)[self.token], self.per_passage)


def pooled(logits: np.ndarray, per_text: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's passages, and the share each passage has in it."""
    texts = np.flatnonzero(per_text)
    starts = (np.cumsum(per_text) - per_text)[texts]
    top = np.maximum.reduceat(logits, starts) if len(texts) else np.zeros(0)
    owner = np.repeat(np.arange(len(texts)), per_text[texts])
    share = np.exp(sharpness * (logits - top[owner]))
    total = np.add.reduceat(share, starts) if len(texts) else np.zeros(0)
    share /= total[owner]
    value = np.zeros(len(per_text))
    value[texts] = np.add.reduceat(share * logits, starts) if len(texts) else 0
    return value, share


@dataclass
class Model:
    weights: np.ndarray  # logit of each bucket
    bias: float
    sharpness: float
    constant: float | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of all texts, some megabytes at a time."""
        parts = [self._scores(part) for part in slices(texts, SLICE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, texts: pa.Array) -> np.ndarray:
        passages = Passages.of(texts)
        some = passages.per_text > 0
        if self.constant is not None:
            return np.where(some, self.constant, 0.0)
        value, _ = pooled(passages.logits(self.weights), passages.per_text, self.sharpness)
        return np.where(some, 1 / (1 + np.exp(-np.clip(value + self.bias, -40, 40))), 0.0)


def train(
    texts: list[str] | pa.Array, toxic: list[int] | np.ndarray, rounds: int = 100, rate: float = 100.0, momentum: float = 0.9, decay: float = 1e-6,
    least: int = LEAST, seed: int = 5,
) -> Model:
    """Vectors and softmax together, by gradient descent over all texts at once.

    The pooling starts near the mean of a text's passages and ends near their
    maximum.  n-grams of fewer than `least` texts teach nothing.  Plain descent
    is on purpose: an n-gram moves by how many texts it explains.
    """
    passages = Passages.of(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    use = passages.per_text > 0
    label = np.array(toxic, np.float64)
    if not (label[use] == 0).any() or not (label[use] == 1).any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(label.mean()) if len(label) else 0.0)
    weight = np.where(label == 1, 0.5 / (label[use] == 1).sum(), 0.5 / (label[use] == 0).sum()) * use
    of_word = np.repeat(np.arange(len(passages.per_word), dtype=np.int32), passages.per_word)
    known = _common(passages, of_word, least)
    local, of_word = passages.buckets[known], of_word[known]
    del known
    place = np.zeros(BUCKETS, np.int32)
    place[local] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used), dtype=np.int32)
    local = place[local]
    passages.buckets = passages.buckets[:0]
    per_word = np.maximum(passages.per_word, 1)
    of_passage = np.repeat(np.arange(len(passages.per_passage), dtype=np.int32), passages.per_passage)
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.01, (len(used), DIMENSIONS))
    softmax = np.ones(DIMENSIONS)
    bias, sharpness = 0.0, 0.5
    speed = [np.zeros_like(vectors), np.zeros_like(softmax), 0.0]
    for step in range(1, rounds + 1):
        sharpness = min(0.5 * 1.04**step, 6.0)
        bucket = np.einsum("ij,j->i", vectors, softmax)  # no library threads: Spark counts cores
        word = _sums(of_word, bucket, local, len(per_word)) / per_word
        passage = _means(word[passages.token], passages.per_passage)
        value, share = pooled(passage, passages.per_text, sharpness)
        error = weight * (1 / (1 + np.exp(-np.clip(value + bias, -40, 40))) - label)
        to_passage = np.repeat(error, passages.per_text) * share / passages.per_passage
        to_word = np.bincount(passages.token, to_passage[of_passage], len(word)) / per_word
        to_bucket = _sums(local, to_word, of_word, len(used))
        steps = [rate * (to_bucket[:, None] * softmax + decay * vectors), 0.01 * rate * np.einsum("i,ij->j", to_bucket, vectors), 0.1 * error.sum()]
        speed = [momentum * v - g for v, g in zip(speed, steps)]
        vectors += speed[0]
        softmax += speed[1]
        bias += speed[2]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = np.einsum("ij,j->i", vectors, softmax)
    return Model(weights, float(bias), sharpness)


def _sums(group: np.ndarray, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of `values[at]` by group, a part at a time: pairs of words and subwords are the largest arrays there are."""
    total = np.zeros(n)
    for lo in range(0, len(group), PART):
        part = slice(lo, lo + PART)
        total += np.bincount(group[part], values[at[part]], n)
    return total


def _common(passages: Passages, of_word: np.ndarray, least: int) -> np.ndarray:
    """Which subwords have a bucket that `least` texts use, a word counted once per text."""
    of_text = np.repeat(np.repeat(np.arange(len(passages.per_text)), passages.per_text), passages.per_passage)
    of_text *= len(passages.per_word)
    of_text += passages.token
    pairs = np.unique(of_text)
    del of_text
    texts = np.bincount(pairs % len(passages.per_word), minlength=len(passages.per_word))
    del pairs
    return (_sums(passages.buckets, texts, of_word, BUCKETS) >= least)[passages.buckets]


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[str, int]]:
    """The rows of `sample_table`, as pairs."""
    rows = sample_table(docs, labels, per_class)
    return list(zip(*(rows.column(name).to_pylist() for name in ("text", "toxic"))))


def sample_table(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> pa.Table:
    """(text, toxic) of at most `per_class` labelled documents of each class, those with the least hashes of their id."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = None
    for value in (0, 1):
        some = marks.where(F.col("toxic") == value).orderBy(*order).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = chosen.collect()  # 2 * per_class pairs of numbers at most
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in rows], "doc_id bigint, toxic int")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return texts.select("text", "toxic").toArrow().sort_by("text").combine_chunks()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    rows = sample_table(docs, labels, per_class)
    model = train(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy())
    del rows
    give_back()
    return model


def give_back() -> None:
    """Return freed memory to the system: the driver goes on after it has learned."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(ctypes.CDLL(libc), "malloc_trim"):
        ctypes.CDLL(libc).malloc_trim(0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` and `score`."""
    columns = [c for c in docs.columns if c.lower() != "score"]
    frame = docs.select(*(F.col(f"`{c}`") for c in columns))
    at = columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*columns, "score"])

    return frame.mapInArrow(run, frame.withColumn("score", F.lit(None).cast("double")).schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the document must not teach: a third of all, by the checksum of its id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
