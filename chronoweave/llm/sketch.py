"""SetSketch registers: exponentially spaced, truncated minima of hashed sets.

Register i of a set is floor(1 - log_b(x_i)), cut to 0 .. 2**16 - 1, where x_i is the set's smallest
exponential variate of rate RATE drawn by hash i. Registers of a union are the element-wise maximum, so
sketches merge; the share of equal registers is about the Jaccard similarity, so bands of them serve as
locality-sensitive keys; and the counts of larger, smaller and equal registers give a joint estimate.
"""

from __future__ import annotations

import functools
import math

import numpy as np

from .tokens import U64, mix

#: Rows in a band; the chance at most that a pair at the threshold misses every band, or is estimated below the floor.
ROWS, MISS = 4, 2e-6
BASE, RATE = 1.001, 20.0


@functools.cache
def size_for(percent: int) -> int:
    """Registers for a threshold: as many bands as it takes, 18 for 85 and 25 for 80 percent."""
    out = 1 - (percent / 100) ** ROWS
    return ROWS * max(1, math.ceil(math.log(MISS) / math.log(out)) if out > 0 else 1)


@functools.cache
def floor_for(percent: int) -> float:
    """The share of equal registers that a pair at the threshold falls below with a chance of MISS at most (binomial)."""
    m, p, below, k = size_for(percent), percent / 100, 0.0, 0
    while k < m:
        below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if below > MISS:
            break
        k += 1
    return min(k / m, 0.95 * p)


SIZE = size_for(85)


@functools.cache
def _multipliers(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def registers(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Of a set of 64-bit hashes, which isn't empty."""
    least = np.full(size, ~U64(0), dtype=U64)
    for lo in range(0, len(elements), 4096):
        x = elements[lo : lo + 4096, None] * _multipliers(size)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=0), out=least)
    u = (least.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    r = regs.reshape(-1, ROWS).astype(U64)
    packed = (r[:, 0] << U64(48)) | (r[:, 1] << U64(32)) | (r[:, 2] << U64(16)) | r[:, 3]
    return mix(packed ^ mix(np.arange(5000, 5000 + len(r), dtype=U64))).view(np.int64)


def _likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(x) + less * np.log(y) + equal * np.log(np.maximum(1 - x - y, 1e-12))

    return likelihood, u, v


def at_least(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether the likeliest similarity is at least this: the likelihood, which has one peak, still rises there."""
    likelihood, _, _ = _likelihood(a, b, na, nb)
    return likelihood(least + 1e-6) >= likelihood(least)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of rows of registers a and b, given the sets' sizes.

    With u and v as shares of the summed sizes, a register of a is larger with probability
    p(u - v J), smaller with p(v - u J), p(x) = -log_b(1 - x (b - 1) / b).
    """
    likelihood, u, v = _likelihood(a, b, na, nb)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        c, d = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        right = likelihood(c) < likelihood(d)
        lo, hi = np.where(right, c, lo), np.where(right, hi, d)
    return (lo + hi) / 2
