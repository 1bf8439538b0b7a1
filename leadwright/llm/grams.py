"""Rolling hashes over bytes, vectorised."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
#: A random value for each byte, and odd bases of two independent polynomial hashes modulo 2**64.
VALUES = _RNG.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, top = 1, base
    while done < n:
        part = min(done, n - done)
        out[done : done + part] = out[:part] * top
        done, top = done + part, top * top
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray, which: int):
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(VALUES[which][data] * powers(base, len(data)), out=self.sums[1:])
            self.back = powers(inverse, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of each stretch of `width` bytes, by its start."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by the first of them."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
