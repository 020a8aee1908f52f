"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of the letters of words: four letters deep, with
marks for the ends of a word.  Counts come from all learning texts: each task
counts the distinct words of a batch once, Spark adds up (language, gram).
All grams count.  The models lie in sorted arrays of 64-bit keys with a column
per language, in shards of a bounded size: a shard has every gram of some
letters before the last, so it tells the probabilities of its grams alone.
Discounts, letters and pairs of letters are counted in Spark over all grams.
Texts meet one shard at a time and carry the bits told so far; with one shard
that is a single pass.  Only a pair of letters is never split over shards.

A text gets the language of the least cross-entropy per letter.  It is marked
as rejected if that entropy is above what all but a few texts of the language
have, measured on all learning texts of the language.

Defined results: a null text and one without a letter are `und` with score 0
and not rejected; ties go to the language that sorts first; without learning
texts everything is `und`; repeated rows get equal results and count as often
as they occur; an empty table gives an empty one.  A very long text is scored
whole, as a batch part of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from linkloom.llm.pieces import slices
from linkloom.llm.words import split_words
from linkloom.operators.staging import release, staged, staged_by

DEPTH = 4
SHARD_CELLS = 16_000_000  # grams of a shard, times numbers for each
REJECTED_SHARE = 0.005

_U = np.uint64
_IN_WORD = np.zeros(256, bool)  # ASCII letters, and all bytes of other characters
_IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of the words, lower-cased, and the word each belongs to.

    A key holds the letter (or end) in its low 16 bits and the three before it
    above, 0 for what is before the word.
    """
    text = (b" ".join(words) + b" ").decode("utf-8", errors="replace").lower()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = _letters()[code]
    folded = np.where(code > 0xFFFF, (code * np.uint32(2654435761)) >> np.uint32(16) | np.uint32(1), code).astype(_U)
    c = np.where(letter, folded, _U(0))
    back = [np.concatenate([np.zeros(k, _U), c])[: len(c)] for k in range(1, DEPTH)]
    for k in range(1, DEPTH - 1):
        back[k] = np.where(back[k - 1] == 0, _U(0), back[k])
    key = c.copy()
    for k, b in enumerate(back, 1):
        key |= b << _U(16 * k)
    told = letter | (back[0] != 0)
    return key[told], (np.cumsum(code == 32) - (code == 32))[told]


@dataclass
class Batch:
    """Distinct words of some texts: keys of their grams, and where they stand."""

    key: np.ndarray
    word: np.ndarray
    token: np.ndarray
    first: np.ndarray
    n_words: int

    @classmethod
    def of(cls, texts: pa.Array) -> Batch:
        words = split_words(texts, _IN_WORD, fold=True)
        _, chosen, token = np.unique(words.hash, return_index=True, return_inverse=True)
        body = words.data.tobytes()
        spelled = [body[a:b] for a, b in zip(words.start[chosen].tolist(), words.end[chosen].tolist())]
        key, word = grams_of(spelled) if spelled else (np.zeros(0, _U), np.zeros(0, np.int64))
        return cls(key, word, token.reshape(-1), words.first, len(spelled))


def counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n): grams of all texts of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in slices(batch.column(0)):
                langs = batch.column(1).slice(lo, len(texts)).dictionary_encode()
                lo += len(texts)
                found = Batch.of(texts)
                of_text = langs.indices.to_numpy(zero_copy_only=False)
                of_token = np.repeat(of_text, np.diff(found.first))
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    often = np.bincount(found.token[of_token == i], minlength=found.n_words)[found.word]
                    use = often > 0
                    key, place = np.unique(found.key[use], return_inverse=True)
                    n = np.bincount(place.reshape(-1), often[use], len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "key", "n"]
                    )

    told = docs.select("text", "lang").mapInArrow(run, "lang string, key bigint, n bigint")
    return told.groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """For each depth: sorted keys of grams with their own part, sorted contexts with the weight of the depth below."""

    langs: list[str] = field(default_factory=list)
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """log2 P(letter | letters before) in each language, for each key."""
        p = np.broadcast_to(self.floor, (len(key), len(self.langs))).astype(np.float64)
        for depth in range(1, DEPTH + 1):
            short = key & _mask(depth)
            p = _rows(*self.grams[depth - 1], short, 0.0) + _rows(*self.contexts[depth - 1], short >> _U(16), 1.0) * p
        return np.log2(p)

    def bits(self, texts: pa.Array, span: Span) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text's grams within the span in each language, and the number of letters and ends of the text."""
        found = Batch.of(texts)
        n = len(found.first) - 1
        key, place = np.unique(found.key, return_inverse=True)
        own = span.holds(key)
        bits = np.zeros((len(key), len(self.langs)))
        bits[own] = -self.log_probabilities(key[own])
        place = place.reshape(-1)
        sizes = np.bincount(found.word, minlength=found.n_words)
        told = _sums(sizes[found.token].astype(np.float64), found.first)
        total = np.zeros((n, len(self.langs)))
        for i in range(len(self.langs)):
            of_word = np.bincount(found.word, bits[place, i], found.n_words)
            total[:, i] = _sums(of_word[found.token], found.first)
        return total, told


@dataclass(frozen=True)
class Span:
    """Grams whose letter before the last is one of `lo` to `hi`, and the one before that is `rest` modulo `of`."""

    lo: int = 0
    hi: int = 0xFFFF
    of: int = 1
    rest: int = 0

    def holds(self, key: np.ndarray) -> np.ndarray:
        last, prior = (key >> _U(16)) & _mask(1), (key >> _U(32)) & _mask(1)
        return (last >= _U(self.lo)) & (last <= _U(self.hi)) & (prior % _U(self.of) == _U(self.rest))

    def sql(self) -> Column:
        last, prior = (F.shiftrightunsigned("key", k).bitwiseAND(0xFFFF) for k in (16, 32))
        return last.between(self.lo, self.hi) & (prior % self.of == self.rest)


def spans(sizes: dict[int, int], most: int) -> list[Span]:
    """Spans of at most `most` grams that hold every key, from the number of grams by the letter before the last."""
    found, lo, held = [], 0, 0
    for letter in sorted(sizes):
        size = sizes[letter]
        if held and held + size > most:
            found.append(Span(lo, letter - 1))
            lo, held = letter, 0
        if size > most:
            if lo < letter:
                found.append(Span(lo, letter - 1))
            of = -(-size // most)
            found.extend(Span(letter, letter, of, rest) for rest in range(of))
            lo, held = letter + 1, 0
        else:
            held += size
    return [*found, Span(lo)] if lo <= 0xFFFF else found


@dataclass
class Shards:
    """Models of all languages, shard by shard."""

    langs: list[str] = field(default_factory=list)
    parts: list[tuple[Span, Broadcast]] = field(default_factory=list)
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.langs:
            return _judged([], self.limit, np.zeros((len(texts), 0)), np.zeros(len(texts)))
        told = [shared.value.bits(texts, span) for span, shared in self.parts]
        return _judged(self.langs, self.limit, sum(bits for bits, _ in told), told[0][1])


def _judged(langs: list[str], limit: np.ndarray, bits: np.ndarray, told: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) from each text's bits; the score is the language's share of the evidence of up to 64 letters."""
    if not langs:
        return ["und"] * len(told), np.zeros(len(told)), np.zeros(len(told), bool)
    entropy = bits / np.maximum(told, 1)[:, None]
    best = entropy.argmin(1)
    least = entropy[np.arange(len(best)), best]
    share = np.exp2(-(entropy - least[:, None]) * np.minimum(told, 64)[:, None])
    score = np.where(told > 0, 1 / share.sum(1), 0.0)
    names = [langs[b] if t else "und" for b, t in zip(best.tolist(), (told > 0).tolist())]
    return names, score, (told > 0) & (least > limit[best])


def _mask(depth: int) -> np.uint64:
    return _U((1 << 16 * depth) - 1)


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def build(rows: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from all (keys, counts) of each language."""
    langs = sorted(rows)
    levels = [[rows[lang]] for lang in langs]
    for found in levels:
        for depth in range(DEPTH - 1, 0, -1):
            found.insert(0, _continued(found[0][0], depth))
    discounts = [[_discount(int((n == 1).sum()), int((n == 2).sum())) for _, n in found] for found in levels]
    return _model(langs, levels, discounts)


def _continued(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of `depth` letters: they count by how many different letters come before them."""
    return np.unique(key & _mask(depth), return_counts=True)


def _discount(once: int, twice: int) -> float:
    return min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)


def _model(langs: list[str], levels: list[list[tuple[np.ndarray, np.ndarray]]], discounts: list[list[float]]) -> Model:
    """Models from (keys, counts) and discounts by language and depth; every depth has all grams of each of its contexts."""
    parts = [[] for _ in range(DEPTH)]
    weights = [[] for _ in range(DEPTH)]
    for found, less in zip(levels, discounts):
        for depth, ((key, n), discount) in enumerate(zip(found, less)):
            context, place = np.unique(key >> _U(16), return_inverse=True)
            place = place.reshape(-1)
            total, kinds = np.bincount(place, n, len(context)), np.bincount(place, minlength=len(context))
            parts[depth].append((key, (n - np.minimum(discount, n)) / total[place]))
            weights[depth].append((context, np.minimum(discount * kinds / total, 1.0)))
    size, letters = len(langs), 1 + max(len(found[0][0]) for found in levels)
    grams, contexts = [_table(p, size, 0.0) for p in parts], [_table(w, size, 1.0) for w in weights]
    return Model(langs, grams, contexts, np.full(size, 1.0 / letters))


def _table(columns: list[tuple[np.ndarray, np.ndarray]], size: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in columns]))
    values = np.full((len(keys), size), missing, np.float32)
    for i, (k, v) in enumerate(columns):
        values[np.searchsorted(keys, k), i] = v
    return keys, values


def fit(docs: DataFrame, shard_cells: int = SHARD_CELLS) -> Shards:
    """Models of every non-null `lang` of (text, lang) and their rejection limits, from all texts."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    model = _shards(staged(counts(known)), shard_cells)
    if not model.langs:
        return model
    langs = model.langs

    def finish(batch: pa.RecordBatch, bits: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
        own = pc.index_in(batch.column(1), pa.array(langs, pa.string())).fill_null(0).to_numpy(zero_copy_only=False)
        entropy = bits[np.arange(len(own)), own] / np.maximum(told, 1)
        use = pa.array(told > 0)
        return pa.RecordBatch.from_arrays([batch.column(1).filter(use), pa.array(entropy).filter(use)], names=["lang", "entropy"])

    texts = _told(known, model, "text", finish, "lang string, entropy double")
    for r in texts.groupBy("lang").agg(F.percentile_approx("entropy", 1 - REJECTED_SHARE).alias("limit")).collect():
        model.limit[langs.index(r.lang)] = r.limit
    return model


def _shards(found: DataFrame, shard_cells: int) -> Shards:
    """Models of the counted grams (lang, key, n).

    To the driver come two numbers per language and depth, what is counted by
    single letters, and the grams of one shard at a time.
    """
    levels = [found]
    for depth in range(DEPTH - 1, 0, -1):
        short = levels[0].select("lang", F.col("key").bitwiseAND(F.lit(int(_mask(depth)))).alias("key"))
        levels.insert(0, short.groupBy("lang", "key").agg(F.count("*").alias("n")))
    levels[1] = staged(levels[1])
    levels[0] = levels[1].select("lang", F.col("key").bitwiseAND(0xFFFF).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    seen = [f.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect() for f in levels]
    langs = sorted(r.lang for r in seen[0])
    if not langs:
        return Shards()
    less = [{r.lang: _discount(r.once, r.twice) for r in rows} for rows in seen]
    discounts = [[by_lang[lang] for by_lang in less] for lang in langs]
    letters = _by_lang(levels[0], langs)
    last = F.shiftrightunsigned("key", 16).bitwiseAND(0xFFFF)
    sizes = {r.letter: r["count"] for r in found.groupBy(last.alias("letter")).count().collect()}
    model = Shards(langs, [], np.full(len(langs), np.inf))
    for span in spans(sizes, max(shard_cells // (len(langs) + 2), 1)):
        whole = _by_lang(found.where(span.sql()), langs)
        pairs = _by_lang(levels[1].where(Span(span.lo, span.hi).sql()), langs)
        own = [[letters[i], pairs[i], _continued(whole[i][0], 3), whole[i]] for i in range(len(langs))]
        model.parts.append((span, found.sparkSession.sparkContext.broadcast(_model(langs, own, discounts))))
    return model


def _by_lang(rows: DataFrame, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of each language, by key."""
    table = rows.select("lang", "key", "n").toArrow().combine_chunks()
    of = pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy()
    key, n = table["key"].to_numpy().view(_U), table["n"].to_numpy().astype(np.float64)
    order = np.lexsort((key, of))
    key, n, ends = key[order], n[order], np.searchsorted(of[order], np.arange(len(langs) + 1))
    return [(key[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _told(frame: DataFrame, model: Shards, text: str, finish: Callable, schema: StructType | str) -> DataFrame:
    """What `finish` makes of (batch, bits in each language, letters) for batches of `frame`.

    A pass for each shard; all but the last write the bits told so far beside
    the columns, so that a task has one shard only.
    """
    columns, at = frame.columns, frame.columns.index(text)
    place = None
    for number, (span, shared) in enumerate(model.parts or [(None, None)]):
        first, end = number == 0, number >= len(model.parts) - 1

        def run(batches: Iterator[pa.RecordBatch], span=span, shared=shared, first=first, end=end) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lo = 0
                for texts in slices(batch.column(at)):
                    part = batch.slice(lo, len(texts))
                    lo += len(texts)
                    if shared is None:
                        bits, told = np.zeros((len(texts), 0)), np.zeros(len(texts))
                    else:
                        bits, told = shared.value.bits(texts, span)
                    if not first:
                        bits += part.column(len(columns)).flatten().to_numpy().reshape(bits.shape)
                    own = pa.RecordBatch.from_arrays(part.columns[: len(columns)], names=columns)
                    if end:
                        yield finish(own, bits, told)
                    else:
                        so_far = pa.ListArray.from_arrays(np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1], bits.reshape(-1))
                        yield pa.RecordBatch.from_arrays([*own.columns, so_far], names=[*columns, "__bits"])

        if end:
            return frame.mapInArrow(run, schema)
        before, frame = place, frame.mapInArrow(run, StructType([*frame.schema.fields[: len(columns)], StructField("__bits", ArrayType(DoubleType()))]))
        since = len(staged_by(spark := frame.sparkSession))
        frame = staged(frame)
        if before:
            release(spark, before)
        place = staged_by(spark, since)


def predict(docs: DataFrame, model: Shards, text: str = "text") -> DataFrame:
    """All columns of `docs`, and `lang_pred`, `score`, `rejected`."""
    made = ["lang_pred", "score", "rejected"]
    columns = [c for c in docs.columns if c.lower() not in made]
    frame = docs.select(*(F.col(f"`{c}`") for c in columns))
    langs, limit = model.langs, model.limit

    def finish(batch: pa.RecordBatch, bits: np.ndarray, told: np.ndarray) -> pa.RecordBatch:
        names, score, rejected = _judged(langs, limit, bits, told)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=[*columns, *made])

    schema = frame.selectExpr("*", "'' AS lang_pred", "0.0D AS score", "true AS rejected").schema
    return _told(frame, model, text, finish, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the document must not teach: a quarter of all, by the checksum of its id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
