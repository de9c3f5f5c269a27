"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Code points handled at once; a longer text is worked off in overlapping slices.
SLICE = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashed(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket (below 2**bits) of each n-gram of the code points, in order; empty if there are fewer than n."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h *= _MUL
        h += cp[k : k + m]
    h ^= h >> np.uint64(29)
    h *= _MUL
    return (h >> np.uint64(64 - bits)).view(np.int64)


def slices(cp: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Parts whose n-grams together are those of the whole, each once."""
    for at in range(0, max(1, len(cp) - n + 1), SLICE):
        yield cp[at : at + SLICE + n - 1]


def text_buckets(cp: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    for n in orders:
        for part in slices(cp, n):
            yield hashed(part, n, bits)
