"""Vectorised 64-bit hashes of a text's words and word sequences (numpy, inside tasks).

A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64 and then mixed; a
sequence's hash is a polynomial over its words' hashes. All runs in a few array passes per text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers one more than twice an odd number, so that differences of positions keep 63 bits.
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C13 | 3, (0xD6E8FEB86659FD93, 0xA0761D6478BD642B)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size <= n:
            size = max(2 * self.up.size, n + 1, 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = Powers(BYTE_BASE), tuple(Powers(b) for b in WORD_BASES)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of UTF-8 bytes."""
    inside = np.zeros(raw.size + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of a text's words; ``lower`` folds A-Z only."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends = word_spans(raw)
    if not starts.size:
        return np.zeros(0, np.uint64), starts, ends
    up, down = _BYTE_POWERS.to(raw.size)
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw] if lower else raw] * up[: raw.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


class Sequences:
    """Hashes of any run of words, from prefix sums over the words' hashes."""

    def __init__(self, words: np.ndarray, which: int = 0):
        self.up, self.down = _WORD_POWERS[which].to(words.size)
        self.sums = np.zeros(words.size + 1, np.uint64)
        np.cumsum(words * self.up[: words.size], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the lower-cased text; the whole sequence if it is shorter."""
    words = word_hashes(text, lower=True)[0]
    if not words.size:
        return words
    n = max(1, words.size - k + 1)
    starts = np.arange(n)
    return np.unique(Sequences(words).of(starts, np.minimum(starts + k, words.size)))
