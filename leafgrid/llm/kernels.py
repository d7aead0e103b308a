"""Vectorised text kernels over Arrow string buffers.

Texts stay in the UTF-8 buffers Arrow hands over; words, word hashes and word
shingles of a whole batch come from a few NumPy passes, so no Python loop runs
per word.  White space is ``[\\x20\\x09-\\x0D]`` throughout, a word is a maximal
run of other bytes (UTF-8 continuation bytes are never white space, so byte
runs are code-point runs).  Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another system's library, which has no such call
    _LIBC = None

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_K = np.uint64(0x9E3779B97F4A7C15)
_S33, _S29 = np.uint64(33), np.uint64(29)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Longer byte runs are hashed one by one, so a single endless word costs no vector step per 8 bytes.
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S29)
    h = h * _M2
    return h ^ (h >> _S33)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls become empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo, hi = int(at[0]), int(at[-1])
    return raw[lo:hi], at - lo


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each (one row at least); memory is given back after the last."""
    _, at = buffers(batch.column(column))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
    release()


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that cross no text's border, and each text's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[at] = True
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    starts = np.flatnonzero(fresh)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first word of each text (n + 1 entries)."""
    return runs(~SPACE[data], at)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, eight bytes a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(np.uint64) * _K + np.uint64(1))
    todo, at = None, 0
    while True:
        live = np.flatnonzero((size > at) & (size <= _LONG)) if todo is None else todo[size[todo] > at]
        if not len(live):
            break
        v = wide[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ v) * _K)
        todo, at = live, at + 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, text by text, and each text's first window.

    A text with 1 to k - 1 words has its whole sequence as one window, a text without words none.
    """
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ptr = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(ptr[-1]), dtype=np.uint64)
    # the index of each window's first word
    at = np.arange(len(out)) - np.repeat(ptr[:-1], many) + np.repeat(first[:-1], many)
    span = np.repeat(np.minimum(n, k), many)
    full = span == k
    base = at[full]
    acc = np.zeros(len(base), dtype=np.uint64)
    for j in range(k):
        acc = (acc ^ h[base + j]) * _K if j == 0 else mix(acc) + h[base + j] * _K
    out[full] = mix(acc)
    for i in np.flatnonzero(~full):
        acc1 = mix(np.array([span[i]], dtype=np.uint64))
        for j in range(int(span[i])):
            acc1 = mix((acc1 ^ h[at[i] + j]) * _K)
        out[i] = acc1[0]
    return out, ptr


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data, at = buffers(column)
    data = LOWER[data]
    starts, ends, first = words(data, at)
    h, ptr = shingle_hashes(hash_runs(data, starts, ends), first, k)
    for i in range(len(at) - 1):
        yield np.unique(h[ptr[i] : ptr[i + 1]])
