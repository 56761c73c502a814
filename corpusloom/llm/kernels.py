"""Vectorised text kernels shared by the operators of this package.

All of them work on a block of texts laid end to end, so that the cost is a few NumPy passes over the characters and
not a Python call for each word. Hashes are 64-bit polynomial hashes modulo 2**64 over scrambled character codes; the
odd base has an inverse, so the hash of any stretch comes from two prefix values.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        full = np.full(size, base, U)
        full[0] = 1
        _pow[base] = have = np.cumprod(full, dtype=U)
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with len(codes)+1 entries; stretch [s, e) has the hash (H[e]-H[s]) * INVERSE**s."""
    h = np.empty(len(codes) + 1, U)
    h[0] = 0
    v = scramble(codes.astype(U) + U(0x632BE59BD9B4E019))
    v *= powers(BASE, len(codes))
    np.cumsum(v, out=h[1:])
    return h


def stretch_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (h[e] - h[s]) * powers(INVERSE, len(h))[s]


def blocks(texts: list[str], limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Slices of texts of about limit characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _ascii_table() -> np.ndarray:
    t = np.zeros(128, bool)
    t[ord("0") : ord("9") + 1] = t[ord("a") : ord("z") + 1] = True
    return t


ASCII_WORD = _ascii_table()
_unicode = np.full(0x110000, 2, np.uint8)


def unicode_word(codes: np.ndarray) -> np.ndarray:
    """For each code point whether it is a letter or a number of any script."""
    kind = _unicode[codes]
    for c in np.unique(codes[kind == 2]):
        _unicode[c] = unicodedata.category(chr(c))[0] in "LN"
    return _unicode[codes] == 1


class Words:
    """The words of a block of texts: hash, text number, first and last+1 character, all in order."""

    def __init__(self, texts: list[str], unicode: bool = False):
        lowered = [t.lower() for t in texts]
        joined = "\0".join(lowered)
        if unicode:
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            on = unicode_word(codes)
        else:
            codes = np.frombuffer(joined.encode("ascii", "replace"), np.uint8)
            on = ASCII_WORD[codes]
        edge = np.diff(on.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        inside = codes[on]
        h = prefix_hash(inside)
        length = self.end - self.start
        last = np.cumsum(length)
        self.hash = scramble(stretch_hash(h, last - length, last))
        sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
        self.offset = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(self.offset, self.start, "right") - 1
        self.bound = np.searchsorted(self.start, np.append(self.offset, len(codes) + 1))


def runs_of_words(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of n words inside one text."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    inside = np.flatnonzero(words.text[:m] == words.text[n - 1 :])
    h = np.zeros(len(inside), U)
    for i in range(n):
        h = (h ^ words.hash[inside + i]) * U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
    return h, inside


def shingle_sets(texts: list[str], n: int = 3) -> Iterator[tuple[np.ndarray, int]]:
    """For each text its distinct n-word runs as sorted hashes, and its number of words."""
    w = Words(texts)
    h, first = runs_of_words(w, n)
    cut = np.searchsorted(first, w.bound)
    for i in range(len(texts)):
        a = np.sort(h[cut[i] : cut[i + 1]])
        if len(a) > 1:
            a = a[np.concatenate(([True], a[1:] != a[:-1]))]
        yield a, int(w.bound[i + 1] - w.bound[i])


POSITION_BITS = 24


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value in each window of w values, by its upper 40 bits; of equal ones the last.

    The choice depends on nothing but the window's own values. x must be shorter than 2**24.
    """
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = U((1 << POSITION_BITS) - 1)
    x = (x | low) - np.arange(len(x), dtype=U)
    full = np.concatenate((x, np.full(-len(x) % w, np.iinfo(U).max, U))).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (low - (smallest & low)).astype(np.int64)
