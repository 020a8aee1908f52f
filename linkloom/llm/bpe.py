"""BPE encoding and decoding with a pair occurrence index.

Encoding: texts are cut into pieces and these into pre-tokens, each distinct
one once per batch.  All new pre-tokens of a batch lie in one row of symbols,
with the places of every known pair listed under the rank of its merge.  Ranks
that occur are taken in ascending order; a rank is applied at all its places
at once, and the pairs that arise beside them join the lists of their own
(higher) ranks.  Decoding gathers the bytes of each id.

The vocabulary file is a parameter: byte-level BPE as the `tokenizers` library
stores it.  Each merge makes a token of its own, so a pair that contains a
token always ranks behind the merge that makes it; ascending order over the
batch is therefore the order within every pre-token.

Defined results: null and empty texts have no ids and decode to an empty text;
a special token's text is encoded as that token; repeated texts give repeated
rows; an empty table gives an empty one.  A very long text is a batch part of its
own.  `encode` and `decode` keep other columns, but for one named like theirs in
any letters; `digests` returns the columns it names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.pieces import IdLists, cut, joined, slices
from linkloom.llm.words import spread_ranges

#: Fixed value: how byte-level BPE splits text before merging, with white space as Unicode has it.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens and merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            saved = json.load(f)
        if saved["normalizer"] is not None or saved["model"]["ignore_merges"]:
            raise ValueError("only plain byte-level BPE is supported")
        ids = saved["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in saved["model"]["merges"]]
        self.size = max([*ids.values(), *(t["id"] for t in saved["added_tokens"])]) + 1
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        if len(np.unique(self.made)) != len(merges):
            raise ValueError("two merges make one token")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in saved["added_tokens"]}
        texts = [b""] * self.size
        for token, i in ids.items():
            texts[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_size = np.array([len(t) for t in texts], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.path = path

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for a pair that is never merged."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        total = len(symbol)
        # A symbol is its first byte's place; `after` and `before` skip what was merged away.
        after, before = np.arange(1, total + 2), np.arange(-1, total)
        ends = np.cumsum(sizes)
        last = np.zeros(total + 1, bool)
        last[ends[sizes > 0] - 1] = True  # the last symbol of its pre-token
        alive = np.ones(total, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(places: np.ndarray) -> None:
            """List the pairs that begin at these places under their ranks."""
            places = places[~last[places]]
            found = self.ranks(symbol[places], symbol[after[places]])
            places, found = places[found >= 0], found[found >= 0]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            for rank, group in zip(found[starts].tolist(), np.split(places, starts[1:])):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(group)

        if total:
            note(np.arange(total))
        while queue:
            rank = heapq.heappop(queue)
            lists = waiting.pop(rank)
            places = np.sort(np.concatenate(lists))
            places = places[np.diff(places, prepend=-1) > 0]
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            places = places[alive[places] & ~last[places]]
            places = places[(symbol[places] == a) & (symbol[after[places]] == b)]
            if a == b and len(places) > 1:  # of a run of equal symbols, every second place from the left
                chained = np.zeros(len(places), bool)
                chained[1:] = places[1:] == after[places[:-1]]
                starts = np.flatnonzero(~chained)
                within = np.arange(len(places)) - np.repeat(starts, np.diff(np.append(starts, len(places))))
                places = places[within % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            symbol[places] = made
            alive[gone] = False
            last[places] = last[gone]
            following = after[gone]
            after[places] = following
            inner = following <= total - 1
            before[following[inner]] = places[inner]
            left = before[places]
            left = left[left >= 0]
            note(np.concatenate([left, places]))
        counts = np.add.reduceat(np.append(alive, False).astype(np.int64), np.append(ends - sizes, total))[:-1] if len(sizes) else sizes
        return symbol[alive], np.where(sizes > 0, counts, 0)

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "ɐ":
            return PATTERN.findall(text)
        # Characters that libraries may class differently: ask the one whose results count.
        return [text[a:b] for _, (a, b) in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        parts, counts = [], []
        for piece in pieces:
            text = piece.decode()
            n = len(parts)
            at = 0
            for found in self.split_special.finditer(text) if self.split_special and "<|" in text else ():
                parts += [t.encode() for t in self.pre_tokens(text[at : found.start()])] if found.start() > at else []
                parts.append(self.special[found.group()])
                at = found.end()
            parts += [t.encode() for t in self.pre_tokens(text[at:])] if at < len(text) else []
            counts.append(len(parts) - n)
        new = list({p for p in parts if isinstance(p, bytes)})
        ids, sizes = self.merge(new)
        place = {p: i for i, p in enumerate(new)}
        specials = sorted(self.special.values())
        for i, s in enumerate(specials):
            place[s] = len(new) + i
        starts = np.concatenate([np.cumsum(sizes) - sizes, len(ids) + np.arange(len(specials))]).astype(np.int64)
        sizes = np.concatenate([sizes, np.ones(len(specials), np.int64)]).astype(np.int64)
        ids = np.concatenate([ids, np.array(specials, np.int32)])
        index = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
        lengths = sizes[index]
        flat = ids[spread_ranges(starts[index], lengths)]
        of_piece = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int64)]
        return flat, np.diff(of_piece)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are none become U+FFFD."""
        body = self.token_bytes[spread_ranges(self.token_start[ids], self.token_size[ids])].tobytes()
        return body.decode("utf-8", errors="replace").encode()


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Vocabulary, IdLists]:
    return Vocabulary(path), IdLists()


def token_lists(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins, with the end behind."""
    vocab, held = vocabulary(path)
    pieces = cut(texts)
    return joined(*held.of(pieces.distinct, vocab.encode), pieces)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of `docs` and `ids array<int>`."""
    columns = [c for c in docs.columns if c.lower() != "ids"]
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, at):
                ids, bounds = token_lists(part.column(at), path)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*columns, "ids"])

    frame = docs.select(*(F.col(f"`{c}`") for c in columns))
    return frame.mapInArrow(run, frame.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of `rows` and `decoded string`; null ids give a null."""
    columns = [c for c in rows.columns if c.lower() != "decoded"]
    at = columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else vocab.decode(np.array(x, np.int64)).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    frame = rows.select(*(F.col(f"`{c}`") for c in columns))
    return frame.mapInArrow(run, frame.withColumn("decoded", F.lit(None).cast("string")).schema)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode every text, keep digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, _ = vocabulary(path)
        shown = np.array([str(i) for i in range(vocab.size)], dtype=object)
        for batch in batches:
            for part in _parts(batch, 1):
                ids, bounds = token_lists(part.column(1), path)
                names = shown[ids].tolist()
                cuts = bounds.tolist()
                coded = [hashlib.sha256(",".join(names[a:b]).encode()).hexdigest() for a, b in zip(cuts, cuts[1:])]
                plain = [hashlib.sha256(vocab.decode(ids[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), pa.array(coded), pa.array(plain)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGESTS)


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    lo = 0
    for texts in slices(batch.column(at)):
        yield batch.slice(lo, len(texts))
        lo += len(texts)
