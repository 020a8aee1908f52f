"""Alignment of two tokenizers over the same texts.

Both tokenizers cut a text, read with one blank before it, into tokens that
cover its bytes.  Where a token of either ends at the same byte, the text can
be cut; between such places lie the groups, the smallest stretches that both
cover with whole tokens.

Groups come by dividing and conquering at shared cuts: of an interval, the ends
of the first tokenizer nearest to its middle are looked up by bisection among
those of the second; the nearest one that is shared splits the interval in two,
and both halves go on; an interval without a shared cut is a group.  All
intervals of a level are looked up at once.  A blank between two letters begins
a token in both tokenizers (which is checked against their vocabularies), so
texts are first cut there, and each distinct word of a chunk of texts is
encoded and divided once.

How many documents link a pair of ids is counted over all documents: chunks
report their distinct pairs with numbers of documents, Spark adds them up, and
the totals go back to the chunks that asked, by a join on the pair.  A chunk has
a pair once, so no pair is a hot key.  Broadcast is one number per id of the
first vocabulary.

Defined results: texts that are null, empty, or not given back byte by byte by
both tokenizers have no tokens: zeros and an empty `groups`; such documents count
for no pair.  Strings of special tokens are plain text.  A very long text is a
chunk of its own; a long stretch without shared cuts is one group whose equal
tokens are counted, not listed pair by pair.  Repeated rows are documents of their
own; an empty table gives an empty one.  Only the columns named below are returned.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.bpe import Vocabulary
from linkloom.llm.pieces import slices
from linkloom.llm.shipping import lean_workers
from linkloom.llm.words import spread_ranges, text_bytes
from linkloom.operators.staging import staged

CHUNK_BYTES = 2 << 20
LINE_WORDS = 200
PART_WORDS = 10_000  # encoded at once
STRING_BYTES = 4 << 20
OUTPUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
CHUNKS = "chunk bigint, codes array<bigint>, documents array<int>, payload binary"


# --- division at shared cuts -----------------------------------------------------------


def _nearest_shared(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range lo..hi - 1 of first ends: the one nearest to the middle that is shared, or -1, and its place among the second."""
    middle = (lo + hi - 1) // 2
    found, place = np.full(len(lo), -1, np.int64), np.zeros(len(lo), np.int64)
    open_, reach, done = np.flatnonzero(hi > lo), 0, -1
    while len(open_):
        # the ends at a distance of done + 1 to reach on both sides
        parts = []
        for sign in (-1, 1):
            near, far = middle[open_] + sign * (done + 1), middle[open_] + sign * reach
            a, b = (np.maximum(far, lo[open_]), near + 1) if sign < 0 else (near, np.minimum(far, hi[open_] - 1) + 1)
            sizes = np.maximum(b - a, 0)
            parts.append((spread_ranges(a, sizes), np.repeat(open_, sizes)))
        ends, owner = (np.concatenate(x) for x in zip(*parts))
        at = np.searchsorted(ends_b, ends_a[ends])
        hit = np.flatnonzero(ends_b[at] == ends_a[ends])
        order = hit[np.lexsort((ends[hit], np.abs(ends[hit] - middle[owner[hit]]), owner[hit]))]
        best = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        found[owner[best]], place[owner[best]] = ends[best], at[best]
        wide = np.maximum(middle - lo, hi - 1 - middle)
        open_ = open_[(found[open_] < 0) & (wide[open_] > reach)]
        reach, done = 2 * reach + 1, reach
    return found, place


def divide(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Groups of texts as rows (a_lo, a_hi, b_lo, b_hi) of token ranges, in order.

    Ends are bytes counted on over all texts, so they ascend; text t has the
    tokens first[t] to first[t + 1], and its last ends agree.
    """
    some = np.flatnonzero(np.diff(first_a))
    intervals = np.stack([first_a[some], first_a[some + 1], first_b[some], first_b[some + 1]], 1).astype(np.int64)
    leaves = []
    while len(intervals):
        a_lo, a_hi, b_lo, b_hi = intervals.T
        cut, place = _nearest_shared(ends_a, ends_b, a_lo, np.where(b_hi - b_lo > 1, a_hi - 1, a_lo))
        leaves.append(intervals[cut < 0])
        rest, cut, place = intervals[cut >= 0], cut[cut >= 0] + 1, place[cut >= 0] + 1
        left = np.stack([rest[:, 0], cut, rest[:, 2], place], 1)
        right = np.stack([cut, rest[:, 1], place, rest[:, 3]], 1)
        intervals = np.concatenate([left, right])
    found = np.concatenate(leaves) if leaves else np.zeros((0, 4), np.int64)
    return found[np.argsort(found[:, 0], kind="stable")]


# --- the two tokenizers ------------------------------------------------------------------

_MAY_START_BLANK = np.zeros(256, bool)  # first bytes of white space beyond ASCII, and of many other characters
_MAY_START_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class _Side:
    """Bytes of each token, and the ids of words.  `encode` gives the ids of texts, read with a blank before them."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray, encode):
        self.sizes, self.data, self.starts = sizes, data, np.cumsum(sizes) - sizes
        self.encode = encode
        self.names = pa.array(map(str, range(len(sizes))), pa.large_string())

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word begins, with the end behind.

        Most words go through in lines of many, which are cut where the words' bytes end.
        """
        odd = frozenset(np.flatnonzero(_MAY_START_BLANK).tolist())
        plain = [bool(w) and w[0] > 32 and w[-1] > 32 and w[0] not in odd for w in words]
        joined = [w for w, fits in zip(words, plain) if fits]
        lengths = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
        counted, coded, rest = np.zeros(len(joined), np.int64), [], []
        for lo in range(0, len(joined), PART_WORDS):
            part = joined[lo : lo + PART_WORDS]
            lines = [part[i : i + LINE_WORDS] for i in range(0, len(part), LINE_WORDS)]
            for i, (line, ids) in enumerate(zip(lines, self.encode([b" ".join(line).decode() for line in lines]))):
                ids, first = np.array(ids, np.int64), lo + i * LINE_WORDS
                ends, stops = np.cumsum(self.sizes[ids]), np.cumsum(lengths[first : first + len(line)])
                at = np.searchsorted(ends, stops)
                if not len(ends) or ends[-1] != stops[-1] or (ends[at] != stops).any():
                    found = self.encode([w.decode() for w in line])  # some word is not given back
                    ids, at = np.fromiter(chain.from_iterable(found), np.int64), np.cumsum(list(map(len, found))) - 1
                counted[first : first + len(line)] = np.diff(at, prepend=-1)
                coded.append(ids)
        others = [w.decode() for w, fits in zip(words, plain) if not fits]
        for lo in range(0, len(others), LINE_WORDS):
            rest += self.encode(others[lo : lo + LINE_WORDS])
        if not others:
            return np.concatenate([np.zeros(0, np.int64), *coded]), np.concatenate([[0], np.cumsum(counted)])
        fits, sizes, starts = np.array(plain), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[fits], sizes[~fits] = counted, list(map(len, rest))
        all_ids = np.concatenate([*coded, np.fromiter(chain.from_iterable(rest), np.int64)])
        starts[fits] = np.cumsum(counted) - counted
        starts[~fits] = counted.sum() + np.cumsum(sizes[~fits]) - sizes[~fits]
        return all_ids[spread_ranges(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def gives_back(self, ids: np.ndarray, first: np.ndarray, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words' tokens have exactly the words' bytes."""
        covered = np.concatenate([[0], np.cumsum(self.sizes[ids])])[first]
        same = np.diff(covered) == sizes
        token = np.repeat(same, np.diff(first))
        told = self.data[spread_ranges(self.starts[ids[token]], self.sizes[ids[token]])]
        kept = np.repeat(same, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
        same[owner[told != expected[kept]]] = False
        return same


@lru_cache(maxsize=2)
def _byte_level(path: str) -> _Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    vocabulary = Vocabulary(path)
    with open(path, encoding="utf-8") as f:
        splitter = json.load(f)["pre_tokenizer"]
    if splitter["type"] != "ByteLevel" or not splitter["use_regex"]:
        raise ValueError("tokens may go on behind a blank")

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]

    return _Side(vocabulary.token_size, vocabulary.token_bytes, encode)


@lru_cache(maxsize=2)
def _piece_level(path: str) -> _Side:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    n = library.get_piece_size()
    names = [library.id_to_piece(i) for i in range(n)]
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError("a piece goes on behind a blank")
    told = [bytes([int(name[3:5], 16)]) if library.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]

    def encode(texts: list[str]) -> list[list[int]]:
        return library.encode(texts, num_threads=1)

    return _Side(np.array([len(t) for t in told], np.int64), np.frombuffer(b"".join(told), np.uint8), encode)


# --- chunks of texts -------------------------------------------------------------------------

def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words without the blank before them, the word at each place, and each text's first place.

    A text is cut before a single blank between characters that are no white space.
    """
    data, at = text_bytes(texts)
    blank = np.zeros(len(data), bool)
    if len(data) > 2:
        blank[1:-1] = (data[1:-1] == 32) & (data[:-2] > 32) & (data[2:] > 32) & ~_MAY_START_BLANK[data[2:]]
    inner = at[(at > 0) & (at < len(data))]
    blank[inner - 1] = False  # blanks at the seams of two texts belong to their text
    blank[inner] = False
    cuts = np.flatnonzero(blank)
    opens = at[:-1][np.diff(at) > 0]
    starts = np.sort(np.concatenate([cuts, opens]))
    stops = np.append(starts[1:], len(data))[: len(starts)]
    skip = blank[starts].astype(np.int64)
    # bytes without the blanks that were cut at, so that words lie side by side
    kept = np.ones(len(data), bool)
    kept[cuts] = False
    sizes = stops - starts - skip
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data[kept])])
    coded = rows.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # frequent words first: their numbers are small
    order = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)).to_pylist(), place[index], np.searchsorted(starts, at)


def _join(parts: pa.Array, bounds: np.ndarray, sign: str) -> pa.Array:
    """Texts joined range by range."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), pa.scalar(sign, parts.type))


def _pairs(ids_a: np.ndarray, ids_b: np.ndarray, leaves: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, pair code, how often) of the linked ids of each leaf.

    Most leaves have a token of each.  Of the others, equal ids are counted
    before pairs are made.
    """

    def counted(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(lo)), hi - lo)
        keys = np.sort(of << 32 | ids[spread_ranges(lo, hi - lo)])
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, n = keys[at], np.diff(at, append=len(keys))
        return keys & 0xFFFFFFFF, n, np.searchsorted(keys, np.arange(len(lo) + 1) << 32)

    crowded = np.flatnonzero((leaves[:, 1] - leaves[:, 0] > 1) | (leaves[:, 3] - leaves[:, 2] > 1))
    a, n_a, first_a = counted(ids_a, leaves[crowded, 0], leaves[crowded, 1])
    b, n_b, first_b = counted(ids_b, leaves[crowded, 2], leaves[crowded, 3])
    leaf = np.repeat(np.arange(len(crowded)), np.diff(first_a))
    partners = np.diff(first_b)[leaf]
    left, right = np.repeat(np.arange(len(a)), partners), spread_ranges(first_b[leaf], partners)
    sizes = np.ones(len(leaves), np.int64)
    sizes[crowded] = np.diff(first_a) * np.diff(first_b)
    of_leaf = np.repeat(np.arange(len(leaves)), sizes)
    code = ids_a[leaves[of_leaf, 0]] * width + ids_b[leaves[of_leaf, 2]]
    often = np.ones(len(of_leaf), np.int64)
    places = spread_ranges((np.cumsum(sizes) - sizes)[crowded], sizes[crowded])
    code[places], often[places] = a[left] * width + b[right], n_a[left] * n_b[right]
    return of_leaf, code, often


def _linked(ids_a: np.ndarray, ids_b: np.ndarray, leaves: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(leaf, distinct codes, number of the code, how often) of the linked ids of each leaf."""
    leaf, code, often = _pairs(ids_a, ids_b, leaves, width)
    codes, pair = np.unique(code, return_inverse=True)
    return leaf, codes, pair.reshape(-1), often


def _pack(arrays: dict[str, np.ndarray | pa.Array]) -> bytes:
    """Arrays as one compressed Arrow table of a row, read back by `_unpack`.

    Numbers are told by their steps if they ascend, and byte by byte: the first
    bytes of all, then the second ones, which are mostly alike.
    """
    told = {name: v if isinstance(v, pa.Array) else None for name, v in arrays.items()}
    for name, v in arrays.items():
        if told[name] is None:
            ascends = len(v) > 1 and v.dtype != bool and bool((v[1:] >= v[:-1]).all())
            small = _narrow(np.diff(v, prepend=0) if ascends else v)
            told[f"{name}:{small.itemsize}:{int(ascends)}"] = pa.array(small.view(np.uint8).reshape(-1, small.itemsize).T.reshape(-1))
    told = {name: v for name, v in told.items() if v is not None}
    arrays, columns = told, list(told.values())
    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for c in columns]
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(lists, names=list(arrays))
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _unpack(payload: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_next_batch()
    found = {}
    for name, column in zip(batch.schema.names, batch.columns):
        values = column.flatten()
        if ":" in name:
            name, size, ascends = name.split(":")
            raw = np.ascontiguousarray(values.to_numpy().reshape(int(size), -1).T)
            values = raw.view(f"<u{size}").reshape(-1).astype(np.int64)
            values = np.cumsum(values) if ascends == "1" else values
        found[name] = values
    return found


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes as the largest takes."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(next(f"<u{size}" for size in (1, 2, 4, 8) if most < 1 << 8 * size))


def _chunk(doc_ids: pa.Array, texts: pa.Array, a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct pair codes, the documents that link each, and what `_answers` needs of a chunk."""
    words, index, first = _words(texts)
    ids_a, first_a = a.of(words)
    ids_b, first_b = b.of(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    expected = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
    good = a.gives_back(ids_a, first_a, expected, sizes) & b.gives_back(ids_b, first_b, expected, sizes)
    bad_before = np.concatenate([[0], np.cumsum(~good[index])])
    use = (np.diff(first) > 0) & (np.diff(bad_before[first]) == 0)
    width = len(b.sizes)
    ids_a, first_a = _only(ids_a, first_a, good)
    ids_b, first_b = _only(ids_b, first_b, good)
    leaves = divide(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]), first_a, first_b)
    first_leaf = np.searchsorted(leaves[:, 0], first_a)
    leaf, codes, pair, _ = _linked(ids_a, ids_b, leaves, width)
    documents = _documents(index, first, use, np.searchsorted(leaf, first_leaf), pair, len(codes))
    payload = _pack({
        "doc_id": doc_ids, "use": use, "first": first, "index": index, "ids_a": ids_a, "ids_b": ids_b, "first_leaf": first_leaf,
        "leaf_a": leaves[:, 1] - leaves[:, 0], "leaf_b": leaves[:, 3] - leaves[:, 2],
    })
    return codes, documents, payload


def _only(ids: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of good words; the others have none."""
    sizes = np.diff(first) * good
    return ids[np.repeat(good, np.diff(first))], np.concatenate([[0], np.cumsum(sizes)])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def _documents(index: np.ndarray, first: np.ndarray, use: np.ndarray, first_pair: np.ndarray, pair: np.ndarray, n: int) -> np.ndarray:
    """In how many documents each pair is linked, some documents at a time."""
    total = np.zeros(n, np.int64)
    sizes = np.diff(first_pair)
    load = np.concatenate([[0], np.cumsum(sizes[index])])[first]
    lo = 0
    while lo < len(use):
        hi = max(lo + 1, int(np.searchsorted(load, load[lo] + (1 << 18), "right")) - 1)
        places = np.arange(first[lo], first[hi])
        doc = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
        chosen = use[lo:hi][doc]
        keys = _distinct(doc[chosen] * len(sizes) + index[places[chosen]])
        doc, word = keys // max(len(sizes), 1), keys % max(len(sizes), 1)
        linked = pair[spread_ranges(first_pair[word], sizes[word])]
        keys = _distinct(np.repeat(doc, sizes[word]) * n + linked)
        total += np.bincount(keys % max(n, 1), minlength=n)[:n]
        lo = hi
    return total


def chunks(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """Texts of about `size` bytes as one row each: their distinct pairs, and all that is needed to answer for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, number = _byte_level(path_a), _piece_level(path_b), TaskContext.get().partitionId() << 32
        waiting, held = [], 0

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in waiting])
            codes, documents, payload = _chunk(ids, pa.concat_arrays([t for _, t in waiting]), a, b)
            row = [pa.array([number]), pa.array([codes], pa.list_(pa.int64())), pa.array([documents], pa.list_(pa.int32())), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["chunk", "codes", "documents", "payload"])

        for batch in batches:
            lo = 0
            for part in slices(batch.column(1).cast(pa.large_string()), size):
                waiting.append((batch.column(0).slice(lo, len(part)), part))
                lo += len(part)
                held += part.nbytes
                if held >= size:
                    yield flush()
                    waiting, held, number = [], 0, number + 1
        if waiting:
            yield flush()

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, CHUNKS)


def pair_counts(made: DataFrame, path_b: str) -> DataFrame:
    """(code, n, is_best): documents that link each pair, and whether no pair of its first id has more."""
    width = len(_piece_level(path_b).sizes)
    rows = made.select(F.explode(F.arrays_zip("codes", "documents")).alias("x"))
    counted = staged(rows.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.documents").alias("n")))
    first_id = F.expr(f"code div {width}")
    most = counted.groupBy(first_id.alias("a")).agg(F.max("n").alias("most"))  # a row per id of the first vocabulary at most
    joined = counted.withColumn("a", first_id).join(F.broadcast(most), "a")
    return joined.select("code", "n", (F.col("n") == F.col("most")).alias("is_best"))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[bounds])


def _answers(payload: bytes, n: np.ndarray, best: np.ndarray, a: _Side, b: _Side) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of a chunk, given the totals of its pairs."""
    held = _unpack(payload)
    doc_ids, use = held["doc_id"], held["use"].astype(bool)
    first, index, ids_a, ids_b, first_leaf = (held[name] for name in ("first", "index", "ids_a", "ids_b", "first_leaf"))
    bounds_a, bounds_b = (np.concatenate([[0], np.cumsum(held[name])]) for name in ("leaf_a", "leaf_b"))
    leaves = np.stack([bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]], 1)
    leaf, _, pair, often = _linked(ids_a, ids_b, leaves, len(b.sizes))
    first_pair = np.searchsorted(leaf, first_leaf)
    told = pc.binary_join_element_wise(
        _join(a.names.take(pa.array(ids_a)), bounds_a, ","), _join(b.names.take(pa.array(ids_b)), bounds_b, ","), pa.scalar("|", pa.large_string())
    )
    told = _join(told, first_leaf, ";")
    of_word = {
        "n_a": np.diff(bounds_a[first_leaf]), "n_b": np.diff(bounds_b[first_leaf]), "n_groups": np.diff(first_leaf),
        "n_links": _sums(held["leaf_a"] * held["leaf_b"], first_leaf),
        "n_best": _sums(often * best[pair], first_pair), "count_sum": _sums(often * n[pair], first_pair),
    }
    load = np.concatenate([[0], np.cumsum(np.diff(_offsets(told))[index])])[first]
    columns = {name: _sums(values[index], first) * use for name, values in of_word.items()}
    lo = 0
    while lo < len(use):
        hi = max(lo + 1, int(np.searchsorted(load, load[lo] + STRING_BYTES, "right")) - 1)
        kept = np.repeat(use[lo:hi], np.diff(first[lo : hi + 1]))
        sizes = np.diff(first[lo : hi + 1]) * use[lo:hi]
        groups = _join(told.take(pa.array(index[first[lo] : first[hi]][kept])), np.concatenate([[0], np.cumsum(sizes)]), ";")
        numbers = [pa.array(values[lo:hi]) for values in columns.values()]
        yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), *numbers, groups.cast(pa.string())], names=["doc_id", *columns, "groups"])
        lo = hi


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document.

    `path_a` is a byte-level BPE of the `tokenizers` library, `path_b` a
    `sentencepiece` model.  `groups` reads `a1,a2|b1;a3|b2,b3`.  A link is an
    occurrence of a token of each in one group; `count_sum` adds up, over the
    links, how many documents link the pair, and `n_best` counts the links whose
    pair has the most documents of its first id.
    """
    lean_workers(docs.sparkSession)
    made = staged(chunks(docs, path_a, path_b, doc_id, text))
    totals = pair_counts(made, path_b)
    asked = made.select("chunk", F.posexplode("codes").alias("at", "code"))
    told = asked.join(totals, "code").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "n", "is_best"))).alias("told"))
    told = told.select("chunk", F.col("told.n").alias("n"), F.col("told.is_best").alias("best"))
    # a chunk is large: it is hashed to the few numbers it asked for, not sorted
    rows = made.select("chunk", "payload").join(told.hint("shuffle_hash"), "chunk", "left").select("payload", "n", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _byte_level(path_a), _piece_level(path_b)
        for batch in batches:
            for i in range(batch.num_rows):
                n, best = (batch.column(c)[i].values for c in (1, 2))
                numbers = np.zeros(0, np.int64) if n is None else n.to_numpy()
                flags = np.zeros(0, np.int64) if best is None else best.to_numpy(zero_copy_only=False).astype(np.int64)
                yield from _answers(batch.column(0)[i].as_py(), numbers, flags, a, b)

    return rows.mapInArrow(run, OUTPUT)
