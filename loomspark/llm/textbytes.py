"""Vectorised views of UTF-8 text used inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """One byte array and the n + 1 document offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, modulo 2**64."""
    up, _ = _power(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) from the prefix sums."""
    _, down = _power(len(h))
    return mix((h[end] - h[start]) * down[start])


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, from the prefix sums."""
    n = max(0, len(h) - k)
    x = h[k : k + n] - h[:n]
    x *= _power(len(h))[1][:n]
    return mix(x)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than 0x20, 0x09-0x0D."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] |= inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] |= inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(s, off))
    return s, e, np.repeat(np.arange(len(off) - 1), counts)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    m, size = x, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(x: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours."""
    if not len(x):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes that are ``inside``; a run ends with its document."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(inside) + 1, bool)  # a document begins here
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(s, off)))


def ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the spans [start, start + size), one after the other, and the n + 1 bounds of each among them."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return np.repeat(start - at[:-1], size) + np.arange(at[-1]), at


def strings(buf: np.ndarray, at: np.ndarray) -> pa.Array:
    """Arrow strings of the bytes between neighbouring bounds."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))).cast(pa.string())
