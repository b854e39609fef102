"""Words and shingles of Arrow text columns as 64-bit hashes, by whole-array NumPy steps (no loop over words)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at once; one longer text is still taken whole.
BLOCK = 1 << 20
#: Powers are kept up to so many.
KEPT = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = U64(0x9E3779B97F4A7C15)
_P_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}
#: The low bytes of a word, by their number.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_ODD = U64(0x9FB21C651E98DF25)
_libc = ctypes.CDLL(None)


def release() -> None:
    """Hands memory that is free back to the system: a worker lives on between tasks, beside the JVM's own memory."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches that releases memory at its end."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (Stafford's variant 13): bijective, every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(name: str, n: int) -> np.ndarray:
    """Powers of the multiplier or of its inverse; kept until :func:`release`, made anew for very long texts."""
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, BLOCK + 1), _P if name == "up" else _P_INVERSE)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if n > KEPT + 1:
            return p[:n]
        _powers[name] = p
    return _powers[name][:n]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets of the texts in them) for runs of texts of about ``size`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:  # a null may still have bytes
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words lie before each text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each data[start:end], equal for equal bytes (for bytes equal but for A-Z if ``lower``): eight bytes at a time
    go through :func:`mix` with their place; the sum goes through it again with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    whole = np.zeros((len(data) >> 3) + 2, "<u8")
    whole.view(np.uint8)[: len(data)] = _LOWER[data] if lower else data

    def words(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        k, shift = at >> 3, ((at & 7) << 3).astype(U64)
        x = whole[k] >> shift
        x |= (whole[k + 1] << (U64(63) - shift)) << U64(1)
        return x & _MASK[np.minimum(left, 8)]

    length = ends - starts
    h = mix(words(starts, length))
    more = np.flatnonzero(length > 8)
    if len(more):
        n = (length[more] - 1) >> 3
        before = np.cumsum(n) - n
        step = np.arange(1, before[-1] + n[-1] + 1) - np.repeat(before, n)
        x = words(np.repeat(starts[more], n) + (step << 3), np.repeat(length[more], n) - (step << 3))
        h[more] += np.add.reduceat(mix(x ^ step.astype(U64) * _P), before)
    return mix(h ^ length.astype(U64) * _ODD)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text (of all its words, if fewer), and how many lie before each text."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_first = np.concatenate(([0], np.cumsum(n)))
    if not out_first[-1]:
        return np.zeros(0, U64), out_first
    owner = np.repeat(np.arange(len(counts)), n)
    at = first[owner] + np.arange(out_first[-1]) - out_first[owner]
    short = counts[owner] < k
    h = np.zeros(len(at), U64)
    whole = np.concatenate((words, np.zeros(k, U64)))
    for i in range(k):
        h += np.where(short & (i >= counts[owner]), U64(0), whole[at + i] * _SHINGLE[i]) if short.any() else whole[at + i] * _SHINGLE[i]
    return mix(h + np.where(short, counts[owner], k).astype(U64)), out_first


def over_texts(fn: Callable[[pa.RecordBatch, int, np.ndarray, np.ndarray], pa.RecordBatch | None], column: str):
    """A function for mapInArrow: ``fn(batch, first row, bytes, offsets)`` for every block of the text column."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in blocks(batch.column(batch.schema.names.index(column))):
                out = fn(batch, i, data, offsets)
                if out is not None:
                    yield out

    return run
