"""Vectorised text kernels over Arrow batches: byte buffers, words, word hashes, shingles.

A batch is cut into runs of whole documents of about ``SLICE_BYTES``, which bounds the temporaries; a single
longer document makes a run of its own, so texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a copy)."""
    x = x.copy()
    x ^= x >> _U(31)
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_pow = np.ones(1, dtype=_U)
_ipow = np.ones(1, dtype=_U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("_pow", _BASE), ("_ipow", _INV)):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=_U)
    return _pow[:n], _ipow[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(wide)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of whole documents."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + slice_bytes, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the number of words up to each document boundary."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes."""
    up, down = powers(len(data) + 1)
    table = _BYTE if not seed else mix(_BYTE + _U(seed))
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(table[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def shingles(word: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and the bounds by document; a shorter text that has words is one shingle."""
    n = len(word)
    count = np.diff(bounds)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    out_bounds = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(many, out=out_bounds[1:])
    doc = np.repeat(np.arange(len(count)), many)
    first = bounds[:-1][doc] + np.arange(out_bounds[-1]) - out_bounds[:-1][doc]
    width = np.minimum(count[doc], size)
    h = np.zeros(len(first), dtype=_U)
    padded = np.concatenate([word, np.zeros(size, dtype=_U)]) if n else np.zeros(size, dtype=_U)
    for k in range(size):
        part = padded[first + k]
        h = mix(h * _U(_BASE) + np.where(k < width, part, _U(0)))
    return h, out_bounds


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values by document, sorted, and the new bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    out = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(np.bincount(d[keep], minlength=len(bounds) - 1), out=out[1:])
    return v[keep], out


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
