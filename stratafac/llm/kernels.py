"""NumPy kernels over Arrow text buffers, used inside tasks.

Texts are handled as the UTF-8 bytes of an Arrow string array plus offsets, so
no Python string is made per word. A word is a run of bytes outside
``[\\x20\\x09-\\x0D]`` (all of them ASCII, so cutting bytes never cuts a word's
code points). Hashes are polynomials modulo 2^64 over a random byte table,
finished by a mixing step; they depend on the bytes alone, so every task of
every executor computes the same values.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; temporary arrays take about 60 times as much.
SLICE_BYTES = 1 << 20
#: Multipliers of the two independent halves of a 128-bit window print.
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process.

    The package's functions are shipped by value, so module globals are made
    anew for each task; look-up tables that are worth keeping go here.
    """
    return sys.__dict__.setdefault("_stratafac_llm_cache", {})


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (a fixed bijection of uint64)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.empty(n, np.uint64)
    p[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        p[k : k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return p


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte table, powers of the base and of its inverse, at least ``n`` long."""
    cache = worker_cache()
    got = cache.get("powers")
    if got is None or len(got[1]) < n:
        size = max(n, SLICE_BYTES + 4096)
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        got = (table, _powers(_BASE, size), _powers(_BASE_INV, size))
        if size <= 8 * SLICE_BYTES:
            cache["powers"] = got
    return got


def prefix_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums ``c`` and inverse powers ``pi``: the bytes ``[s, e)`` hash to
    ``mix((c[e] - c[s]) * pi[s])``."""
    table, p, pi = _tables(len(b) + 1)
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * p[: len(b)], out=c[1:])
    return c, pi


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def binary_column(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow binary (or string) array over bytes and offsets."""
    off = np.ascontiguousarray(offsets, np.int32 if offsets[-1] < 2**31 else np.int64)
    narrow = off.dtype == np.int32
    want = kind or pa.binary()
    base = {True: {pa.binary(): pa.binary(), pa.string(): pa.string()}, False: {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}}[narrow][want]
    return pa.Array.from_buffers(base, len(offsets) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return t


def words(b: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, 64-bit hash and text index of every word of every text.

    Hashing runs over slices of ``SLICE_BYTES`` that are cut where a word ends,
    so memory per byte of a very long text stays at one byte for the mask and
    what its words need. ``lower`` folds A-Z only.
    """
    space = is_space()[b]
    starts = ~space
    ends = np.zeros(len(b) + 1, bool)
    ends[1:] = starts
    firsts = np.zeros(len(b) + 1, bool)
    firsts[offsets[:-1]] = True
    firsts = firsts[: len(b)]
    if len(b):
        starts[1:] &= space[:-1] | firsts[1:]
        ends[1 : len(b)] &= space[1:] | firsts[1:]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends)
    h = np.empty(len(s), np.uint64)
    fold = None
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SLICE_BYTES, side="right")))
        lo, hi = s[i], e[j - 1]
        piece = b[lo:hi] if fold is None else fold[b[lo:hi]]
        c, pi = prefix_sums(piece)
        a, z = s[i:j] - lo, e[i:j] - lo
        h[i:j] = mix((c[z] - c[a]) * pi[a] + (z - a).astype(np.uint64))
        i = j
    doc = np.searchsorted(offsets, s, side="right") - 1
    return s, e, h, doc


def ngrams(h: np.ndarray, k: int, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hash of every ``k`` consecutive values (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64(multiplier)
    out = h[:n].copy()
    for i in range(1, k):
        out *= m
        out += h[i : n + i]
    return mix(out)


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``n`` places that lie in a run ``[start, start + length)``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    d = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def unique_rows(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the rows by ``keys`` (first key first), and where each
    distinct row begins in that order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    n = len(order)
    if n == 0:
        return order, np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)
