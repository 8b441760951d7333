"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants); a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D | 1
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            base, inverse = U64(_BASE), U64(pow(_BASE, -1, 1 << 64))
            _pow = np.cumprod(np.r_[U64(1), np.full(size - 1, base, dtype=U64)], dtype=U64)
            _inv = np.cumprod(np.r_[U64(1), np.full(size - 1, inverse, dtype=U64)], dtype=U64)
    return _pow, _inv


def columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; null texts have no bytes."""
    a = batch.column(name)
    if pa.types.is_large_string(a.type):
        kind = np.int64
    else:
        a = a.cast(pa.string()) if not pa.types.is_string(a.type) else a
        kind = np.int32
    n = len(a)
    valid = np.asarray(a.is_valid())
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], dtype=kind)[a.offset : a.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off, valid


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row makes a run of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(data: np.ndarray, lo: int, hi: int, sep: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Parts of the text in ``data[lo:hi]`` of about ``size`` bytes that end after a separator, so that no word is cut; a longer word is whole."""
    while lo < hi:
        end = min(hi, lo + size)
        while end < hi and not sep[data[end - 1]]:
            gap = np.flatnonzero(sep[data[end : end + size]])
            end = end + int(gap[0]) + 1 if len(gap) else min(hi, end + size)
        yield lo, end
        lo = end


def word_spans(data: np.ndarray, starts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not separators; rows begin at ``starts``."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~sep[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts[starts <= len(data)]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    b = np.flatnonzero(begin)
    return b, np.flatnonzero(end) + 1, np.searchsorted(starts, b, side="right") - 1


def span_hashes(data: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial modulo 2**64."""
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=c[1:])
        return mix64((c[e] - c[b]) * inverse[b] + (e - b).astype(U64))
