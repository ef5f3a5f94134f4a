"""Vectorised text primitives on Arrow string buffers.

Texts stay UTF-8 bytes. Words, lines and windows are index ranges found with
NumPy; their 64-bit hashes come from prefix sums of ``table[byte] * base**i``,
so hashing costs a few array passes whatever the word lengths. Work goes in
slabs of about ``SLAB`` bytes (a longer text is a slab of its own), which
bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Continuation bytes of UTF-8 do not start a code point.
_LEADS = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLAB + (SLAB >> 2))
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


class Slab:
    """Some whole texts: their bytes, and the byte offset where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._words = None
        self._sums: dict[bool, np.ndarray] = {}

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and where each text's words begin."""
        if self._words is None:
            space = _SPACE[self.data]
            solid = ~space
            starts, ends = solid.copy(), solid.copy()
            starts[1:] &= space[:-1]
            ends[:-1] &= space[1:]
            cut = self.offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(self.data))]
            starts[cut] = solid[cut]
            ends[cut - 1] = solid[cut - 1]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            self._words = s, e, np.searchsorted(s, self.offsets)
        return self._words

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all lines, and where each text's lines begin.

        Lines are what splitting at ``\\n`` gives: an empty text has one.
        """
        feed = np.flatnonzero(self.data == 10)
        of = np.searchsorted(self.offsets, feed, side="right") - 1
        each = np.bincount(of, minlength=self.n) + 1
        first = np.concatenate([[0], np.cumsum(each)])
        starts = np.zeros(first[-1], np.int64)
        ends = np.zeros(first[-1], np.int64)
        within = np.arange(len(feed)) - np.searchsorted(feed, self.offsets[:-1])[of]
        ends[first[of] + within] = feed
        starts[first[of] + within + 1] = feed + 1
        starts[first[:-1]] = self.offsets[:-1]
        ends[first[1:] - 1] = self.offsets[1:]
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes have equal hashes everywhere."""
        power, inverse = _power(len(self.data) + 1)
        if lower not in self._sums:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * power[: len(self.data)], out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def count(self, table: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes ``table`` marks."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(table[self.data], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def code_points(self) -> np.ndarray:
        """For each byte offset, how many code points begin before it."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_LEADS[self.data], out=sums[1:])
        return sums


def slabs(texts: pa.Array | pa.ChunkedArray, size: int = SLAB) -> Iterator[Slab]:
    """The texts (null: empty) of a column, cut into slabs of whole texts."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        _, at, data = chunk.buffers()
        at = np.frombuffer(at, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        k = 0
        while k < len(chunk):
            end = max(k + 1, int(np.searchsorted(at, at[k] + size, side="right")) - 1)
            end = min(end, len(chunk))
            yield Slab(data[at[k] : at[end]], at[k : end + 1] - at[k], k)
            k = end


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside the texts, and the word each begins at."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = mix(rolled * _U(0x9FB21C651E98DF25) + hashes[k : k + n])
    inside = np.zeros(len(hashes) + 1, bool)
    begin, end = first[:-1], first[1:]
    fits = end - begin >= width
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, begin[fits], 1)
    np.add.at(edge, end[fits] - width + 1, -1)
    inside = np.cumsum(edge)[:n] > 0
    at = np.flatnonzero(inside)
    return rolled[at], at


def shingle_sets(slab: Slab, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and where each set begins.

    A text with fewer than ``width`` words has its whole sequence as one
    shingle; a text without words has the empty set.
    """
    starts, ends, first = slab.words
    words = slab.hashes(starts, ends, lower=True)
    rolled, at = windows(words, first, width)
    owner = np.searchsorted(first, at, side="right") - 1
    n = np.diff(first)
    for short in range(1, width):
        texts = np.flatnonzero(n == short)
        if len(texts):
            whole = np.full(len(texts), short, np.uint64)
            for k in range(short):
                whole = mix(whole * _U(0xA0761D6478BD642F) + words[first[texts] + k])
            rolled, owner = np.concatenate([rolled, whole]), np.concatenate([owner, texts])
    rough = (owner.astype(np.uint64) << _U(44)) | (rolled >> _U(20))
    order = np.argsort(rough, kind="stable")
    rough, rolled, owner = rough[order], rolled[order], owner[order]
    if slab.n > 1 << 20 or ((rough[1:] == rough[:-1]) & (rolled[1:] != rolled[:-1])).any():
        order = np.lexsort((rolled, owner))  # hashes that agree in the leading bits only
        rolled, owner = rolled[order], owner[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    rolled, owner = rolled[fresh], owner[fresh]
    return rolled, np.searchsorted(owner, np.arange(slab.n + 1))


_STEP = 0x9E6C63D0876A9A47
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


class Sequences:
    """Hashes of ranges of a word sequence, also with one word left out, by prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.power, self.inverse = np.full((2, n + 1), 1, np.uint64)
        for powers, base in ((self.power, _STEP), (self.inverse, _STEP_INVERSE)):
            powers[1:] = base
            np.cumprod(powers, out=powers)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * self.power[: n - 1], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the words from a to b, b exclusive."""
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def without(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of the words from a to b but word i: equals ``span`` of the same words."""
        left = (self.sums[i] - self.sums[a]) * self.inverse[a]
        right = (self.sums[b] - self.sums[i + 1]) * self.inverse[a + 1]
        return mix(left + right + (b - a - 1).astype(np.uint64))
