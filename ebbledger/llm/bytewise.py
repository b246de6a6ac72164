"""Numpy helpers on the UTF-8 bytes of many texts at once: words, their hashes, hashes of any stretch.

Hashes are polynomials modulo 2**64 over random byte values, taken from running
sums, so that any stretch costs the same; a finishing mix spreads their bits.
They depend on nothing but the bytes, so all tasks agree.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240131)
VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to 4 million."""
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 4_000_000:
            _powers[str(base)] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with a space after each, and where each begins (and the last ends)."""
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8), begins


class Hashes:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes that are not white space."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACES[data], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` words in a row with one owner, and the owners; owners with fewer words give one of them all."""
    if not len(hashes):
        return hashes, owner
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.diff(np.append(firsts, len(owner)))
    left = np.repeat(firsts + counts, counts) - np.arange(len(owner))  # words from here to the owner's end
    at = np.flatnonzero((left >= size) | ((np.arange(len(owner)) == np.repeat(firsts, counts)) & (left < size)))
    length = np.minimum(left[at], size)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        on = length > k
        h[on] = mixed(h[on] * BASE + hashes[at[on] + k])
    return h + length.astype(np.uint64), owner[at]
