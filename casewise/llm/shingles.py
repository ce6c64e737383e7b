"""Word shingles and MinHash values of texts, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
RNG = np.random.default_rng(71)
BYTES = RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = [U(x) for x in RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)]


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        while len(cls.up) <= n:
            k = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * U(pow(int(BASE), k, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * U(pow(int(INVERSE), k, 1 << 64))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of every run of `size` words (split at white space); a shorter text is one run."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8)
    _Powers.reach(len(data))
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
    sums = np.append(U(0), np.cumsum(BYTES[data] * _Powers.up[: len(data)]))
    w = mixed((sums[ends] - sums[starts]) * _Powers.down[starts] + (ends - starts).astype(np.uint64))
    k = min(size, len(w))
    h = sum((w[j : len(w) - k + 1 + j] * STEP[j] for j in range(k)), np.zeros(1, np.uint64)) + U(k)
    return np.unique(mixed(h))


class MinHash:
    """`count` MinHash values of a set of 64-bit hashes, as unsigned 32-bit numbers."""

    def __init__(self, count: int = 128, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, (count, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32)

    def __call__(self, hashes: np.ndarray, block: int = 1024) -> np.ndarray:
        x = (hashes >> U(32)).astype(np.uint32)
        best = None
        for k in range(0, len(x), block):
            y = x[None, k : k + block] ^ self.b
            y *= self.a
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            low = y.min(axis=1)
            best = low if best is None else np.minimum(best, low)
        return best
