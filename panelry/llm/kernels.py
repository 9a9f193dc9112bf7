"""Numpy kernels shared by the text operators: words, rolling hashes, windows.

Every kernel works on one Arrow batch of documents as a flat byte buffer plus document offsets,
so that no Python object is made for a word.  Words are maximal runs of bytes other than
``\\x20`` and ``\\x09-\\x0D``; because UTF-8 continuation bytes are all above 0x7F, splitting the
bytes and splitting the characters give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes, one per independent hash.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection, so that distinct values stay distinct)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its documents; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_binary())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: byte spans ``start``/``end``, and ``first[d]:first[d + 1]`` for document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = np.zeros(len(data) + 2, dtype=bool)
        solid[1:-1] = ~_SPACE[data]
        rise = np.flatnonzero(solid[1:] & ~solid[:-1])
        if len(data) and len(offsets) > 2:  # a document's end also ends a word
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(data))]
            joined = np.unique(cut[solid[cut] & solid[cut + 1]])
        else:
            joined = np.zeros(0, np.int64)
        fall = np.flatnonzero(~solid[1:] & solid[:-1])
        self.start = np.sort(np.concatenate([rise, joined])) if len(joined) else rise
        self.end = np.sort(np.concatenate([fall, joined])) if len(joined) else fall
        self.first = np.searchsorted(self.start, offsets)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``which`` picks one of four independent hashes."""
        data = _LOWER[self.data] if lower else self.data
        base = _BASES[which]
        with np.errstate(over="ignore"):
            table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(table[data] * powers(base, len(data)), out=total[1:])
            # base is odd: dividing by base**start moves every word to exponent zero
            inverse = powers(pow(base, -1, 1 << 64), len(data) + 1)
            h = (total[self.end] - total[self.start]) * inverse[self.start]
            return mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(base))


def windows(h: np.ndarray, first: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of every run of ``width`` consecutive items that lies within one document."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = np.uint64(_BASES[which])
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out *= base
            out += h[k : k + n]
    sizes = np.diff(first)
    left = np.repeat(first[1:], sizes)[:n] - np.arange(n)
    at = np.flatnonzero(left >= width)
    return at, mix(out[at])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length, one after another, as bytes."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
