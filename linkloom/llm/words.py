"""Words of a batch of texts as numpy arrays, for work inside tasks.

Hashes are the same in every process: their constants come from a rule.
Texts are read as UTF-8 bytes, whole, a slice of about a megabyte at a time,
so memory follows the batch and not the number of operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbered(n: int, seed: int) -> np.ndarray:
    """n random-looking 64-bit numbers, always the same."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


BASE = 0xD6E8FEB86659FD93
_BYTES = numbered(256, 7)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]  # A-Z as a-z

#: Bytes of a word, for words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word, for lower-cased words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


@dataclass
class Words:
    """Word i of all texts: its hash and its bytes `data[start[i]:end[i]]`; text d has words first[d] to first[d + 1]."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def of_word(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and where each begins, with the end behind; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array, in_word: np.ndarray, fold: bool = False) -> Words:
    """Words of all texts; with `fold`, A-Z count as a-z."""
    data, at = text_bytes(texts)
    table = _FOLDED if fold else _BYTES
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        if hi < len(data):  # go back to a blank or the start of a text, or on to one
            blank = np.flatnonzero(~in_word[data[lo:hi]])
            text = np.searchsorted(at, hi, "right") - 1
            cut = max(lo + blank[-1] + 1 if len(blank) else lo, at[text])
            while cut <= lo:
                more = np.flatnonzero(~in_word[data[hi : hi + SLICE]])
                following = at[np.searchsorted(at, hi)]
                cut = min(hi + more[0] + 1 if len(more) else len(data), following)
                if not len(more) and hi + SLICE < following:
                    cut, hi = lo, hi + SLICE
            hi = int(cut)
        s, e, h = _slice_words(data[lo:hi], at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo, in_word, table)
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(h)
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return Words(data, np.concatenate(hashes) if hashes else np.zeros(0, _U), start, end, np.searchsorted(start, at))


def _slice_words(data: np.ndarray, texts: np.ndarray, in_word: np.ndarray, table: np.ndarray):
    inside = in_word[data]
    joined = inside[1:] & inside[:-1]
    joined[texts[(texts > 0) & (texts < len(data))] - 1] = False  # a text's first byte joins nothing
    first = inside.copy()
    first[1:] &= ~joined
    last = inside.copy()
    last[:-1] &= ~joined
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, end, np.zeros(0, _U)
    lengths = end - start
    at = np.flatnonzero(inside)
    within = at - np.repeat(start, lengths)
    values = table[data[at]] * powers(BASE, int(lengths.max()) + 1)[within]
    begin = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    return start, end, mix(np.add.reduceat(values, begin) + lengths.astype(_U))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by its first word; runs may cross texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _U(BASE)
        out += hashes[k : k + count]
    return mix(out)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """`grams` of the runs that begin at the given words only."""
    out = hashes[starts].copy()
    for k in range(1, n):
        out *= _U(BASE)
        out += hashes[starts + k]
    return mix(out)


def inside_text(first: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words, by its first word: whether it lies in one text."""
    total = int(first[-1]) if len(first) else 0
    ok = np.ones(max(total - n + 1, 0), dtype=bool)
    for k in range(1, n):  # the last k words of a text begin no run
        cut = first[1:] - k
        cut = cut[(cut >= 0) & (cut < len(ok)) & (cut >= first[:-1])]
        ok[cut] = False
    return ok


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for `lengths[0]` numbers, then the same for the next."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
