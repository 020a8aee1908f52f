"""Texts cut into pieces that a tokenizer treats on their own, each distinct piece once per batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from linkloom.llm.words import spread_ranges, text_bytes

_ENDS_BLANK = np.zeros(256, bool)  # last bytes of white space beyond ASCII, and of some other characters
_ENDS_BLANK[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B)]] = True
_STARTS_BLANK = np.zeros(256, bool)  # first bytes of white space beyond ASCII, and of many other characters
_STARTS_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


@dataclass
class Pieces:
    """Piece i of all texts is `distinct[index[i]]`; text d has pieces first[d] to first[d + 1]."""

    distinct: list[bytes]
    index: np.ndarray
    first: np.ndarray


def cut(texts: pa.Array) -> Pieces:
    """Cut before a single blank or newline that stands between characters that are no white space.

    Where white space beyond ASCII may be next to it, no cut is made.  Marks
    such as a comma are cut off the letter before them.
    """
    data, at = text_bytes(texts)
    n = len(data)
    if n == 0:
        return Pieces([], np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    plain = data > 32
    good = np.zeros(n, bool)
    good[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & plain[:-2] & plain[2:] & ~_STARTS_BLANK[data[2:]]
    spots = np.flatnonzero(good)
    before, prior = data[spots - 1], data[np.maximum(spots - 2, 0)]
    good[spots[_ENDS_BLANK[before] & ((prior == 0xC2) | ((prior >= 0x80) & (prior < 0xC0)))]] = False
    good[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    inner = at[(at > 0) & (at < n)]
    good[inner - 1] = False  # blanks at the seams of two texts
    good[inner] = True  # a text's own start
    good[0] = True
    bounds = np.append(np.flatnonzero(good), n)
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = rows.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Pieces(coded.dictionary.to_pylist(), index, np.searchsorted(bounds[:-1], at))


class IdLists:
    """Growing lists of token ids, found by piece; emptied when a bound of entries is passed."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, pieces: list[bytes], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes): list i is ids[starts[i]:starts[i] + sizes[i]]; `encode` gives the lists of new pieces."""
        if len(self.place) > self.most:
            self.__init__(self.most)
        new = list(dict.fromkeys(p for p in pieces if p not in self.place))
        if new:
            ids, sizes = encode(new)
            starts = len(self.ids) + np.cumsum(sizes) - sizes
            for i, p in enumerate(new, len(self.starts)):
                self.place[p] = i
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.starts = np.concatenate([self.starts, starts])
            self.sizes = np.concatenate([self.sizes, sizes])
        rows = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        return self.ids, self.starts[rows], self.sizes[rows]


def joined(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins, with the end behind."""
    lengths = sizes[pieces.index]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    return ids[spread_ranges(starts[pieces.index], lengths)], ends[pieces.first]


def slices(texts: pa.Array, most: int = 8 << 20):
    """The texts again, some megabytes at a time; one text is never cut."""
    _, at = text_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi
