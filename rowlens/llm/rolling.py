"""Hashes of all k-byte strings of many texts at once, with numpy.

Texts are joined into one byte array. With T a fixed random number per byte
value and B an odd base, P[i] = sum of T[byte j] B^j for j < i modulo 2^64, so
that (P[i + k] - P[i]) B^-i is the polynomial hash of the k bytes from i; a
mixing step then spreads it over all 64 bits.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S1, S2, S3 = np.uint64(30), np.uint64(27), np.uint64(31)

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, B, B^2, ... (or of its inverse), kept for the longest n asked for."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        x = np.full(size, INVERSE if inverse else BASE, np.uint64)
        x[0] = 1
        _powers[key] = have = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The last step of SplitMix64, in place."""
    x ^= x >> S1
    x *= M1
    x ^= x >> S2
    x *= M2
    x ^= x >> S3
    return x


class Prefix:
    """Prefix sums of one byte array."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.p = np.zeros(self.n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(self.n), out=self.p[1:])

    def all(self, k: int) -> np.ndarray:
        """Hash of the k bytes from every position; n - k + 1 of them."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.p[k:] - self.p[: self.n - k + 1]) * powers(self.n - k + 1, True))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to each end."""
        return mix((self.p[end] - self.p[start]) * powers(self.n + 1, True)[start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: of runs of 2, 4, 8, ... and of two runs that overlap."""
    n = len(x)
    if n < w:
        return x[:0]
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: n - w + 1], x[w - k : n - k + 1])
