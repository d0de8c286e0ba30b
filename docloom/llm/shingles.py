"""Word shingles of texts as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype="u1")
_FOLD[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number stands for each byte, so that words hash well whatever their letters.
_OF_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, "u8")
    factors[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(factors)


class _Powers:
    """Powers of the base and its inverse, as many as the longest text so far needed."""

    up = _powers(_BASE, 1024)
    down = _powers(_BASE_INVERSE, 1024)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_BASE_INVERSE, 2 * n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: runs of characters other than blank and U+0009 to U+000D, A-Z lowered."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "u1")
    if not len(data):
        return np.zeros(0, "u8")
    inside = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    up, down = _Powers.upto(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(_OF_BYTE[_FOLD[data]] * up[: len(data)], dtype="u8")))
        return mix((sums[ends] - sums[begins]) * down[begins])


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of all windows of ``n`` words; of fewer words, one of them all."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    count = len(words) - size + 1
    h = np.full(count, size, "u8")
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count])
    return np.unique(h)
