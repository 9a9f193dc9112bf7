"""Lower-cased letter words of a slice of documents as code points, with hashes of any part of a word."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

from .kernels import mix, powers

_BASE = 0x9E3779B97F4A7C15


@cache
def _alpha() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Letters:
    """Words are maximal runs of letters; ``first[d]:first[d + 1]`` are document d's."""

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
        code = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.zeros(len(code) + 1, bool)
        letter[1:] = _alpha()[code]
        turn = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        self.first = np.searchsorted(self.start, edge)
        self.first[-1] = len(self.start)
        with np.errstate(over="ignore"):
            self._total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(mix(code + np.uint64(1)) * powers(_BASE, len(code)), out=self._total[1:])
            self._inverse = powers(pow(_BASE, -1, 1 << 64), len(code) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the code points in [start, end)."""
        with np.errstate(over="ignore"):
            return mix((self._total[end] - self._total[start]) * self._inverse[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``which``, hash) of every n-gram of those words; a word's ends count as characters.

        The ends are told apart by mixing a mark into the first and last gram.
        """
        count = np.maximum(self.end[which] - self.start[which] - n + 1, 0)
        owner = np.repeat(np.arange(len(which)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = self.start[which][owner] + offset
        h = self.hash(at, at + n)
        h[offset == 0] ^= np.uint64(0xD6E8FEB86659FD93)
        h[offset == count[owner] - 1] ^= np.uint64(0xA0761D6478BD642F)
        return owner, mix(h)
