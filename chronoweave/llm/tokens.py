"""Words and shingles of a batch of texts, as numpy arrays over the Arrow buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased; as these separators are
ASCII, working on UTF-8 bytes gives the same words as working on characters. Hashes are 64 bits wide.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Large arrays go back to the system when they are freed, so that an idle worker doesn't hold what it once used.
with contextlib.suppress(OSError, AttributeError):
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    _libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD

U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER_CODE = BYTE_CODE[LOWER]
SHINGLE_CODE = mix(np.arange(1001, 1017, dtype=U64)) | U64(1)


@lru_cache(maxsize=2)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    out = []
    for base in (_RADIX, _RADIX_INV):
        x = np.full(n, base, dtype=U64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    return _powers(max(21, int(n).bit_length()))


class Texts:
    """Some rows of a batch: their bytes, end to end, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, off: np.ndarray):
        self.first, self.data, self.off = first, data, off
        self.n = len(off) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def texts(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[Texts]:
    """The column's rows in runs of about limit bytes, from one row up to `rows`; null is an empty text."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"") if column.null_count else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + rows)
        yield Texts(lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def prefix(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run follows by hash_runs()."""
    out = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def hash_runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U64))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes; no run goes beyond a text."""
    begin, last = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        some = off[:-1] < off[1:]
        a, b = off[:-1][some], off[1:][some] - 1
        begin[a], last[b] = inside[a], inside[b]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


class Words:
    """start, end (byte positions), hash of every word, and the index of each text's first word."""

    def __init__(self, t: Texts, hashes: bool = True):
        data, off = t.data, t.off
        self.start, self.end = runs(~SPACE[data], off)
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)
        if hashes:
            self.hash = hash_runs(prefix(LOWER_CODE[data]), self.start, self.end)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each position, positions that lie in one text).

    Texts with fewer words than k give one shingle of all their words; it is told apart by its length.
    """
    n = len(w.hash)
    text = np.repeat(np.arange(len(w.count)), w.count)
    if n >= k:
        h = w.hash[: n - k + 1] * SHINGLE_CODE[0]
        for j in range(1, k):
            h += w.hash[j : n - k + 1 + j] * SHINGLE_CODE[j]
        inside = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
        h, owner = mix(h[inside]), text[inside]
    else:
        h, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        extra = np.array([_short(w.hash[w.off[i] : w.off[i + 1]]) for i in short], dtype=U64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.searchsorted(owner, np.arange(len(w.count) + 1))


def _short(h: np.ndarray) -> int:
    return int(mix((h * SHINGLE_CODE[: len(h)]).sum(dtype=U64, keepdims=True) + U64(len(h)))[0])
