"""Sets of hashed word shingles, computed for blocks of texts in numpy.

Words are runs of bytes that are not ASCII white space, after lower-casing A-Z.
A set holds the distinct k-word shingles; a text of fewer words has its whole
sequence as one. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

BLOCK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications and three shifts)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def word_hashes(data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of these bytes begin, and their hashes; ``fold``: of A-Z in lower case."""
    size = 1 << max(BLOCK_BYTES.bit_length() + 1, (len(data) + 1).bit_length())
    up, down = powers(size)
    if fold:
        data = data | (((data >= 65) & (data <= 90)).view(np.uint8) << 5)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    return first, mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; empty for null or no word."""
    at = 0
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size + len(texts[at] or b"") <= BLOCK_BYTES):
            block.append(texts[at] or b"")
            size += len(block[-1]) + 1
            at += 1
        data = np.frombuffer(b"\n".join(block), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in block])])
        first, words = word_hashes(data)
        bounds = np.searchsorted(first, begins)
        rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for j in range(k):
            rolled += mix(words[j : j + len(rolled)] + np.uint64((j + 1) * int(_ODD) & MASK))
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = b - a
            if n >= k:
                own = np.sort(rolled[a : b - k + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                places = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * _ODD
                yield mix(mix(words[a:b] + places).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield words[:0]
