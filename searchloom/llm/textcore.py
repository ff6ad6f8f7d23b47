"""Array helpers shared by the text operators: flat views of Arrow string
columns, prefix-sum window hashes, and a cache that lives as long as a worker.
"""

from __future__ import annotations

import sys

import numpy as np

U64 = np.uint64
#: Base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Longest run of symbols hashed with one table of powers.
SEGMENT = 1 << 20


def worker_cache(key, make):
    """make() once a process and key. Kept on `sys`, as functions pickled by
    value get fresh globals in every task."""
    box = sys.__dict__.setdefault("_searchloom_cache", {})
    if key not in box:
        box[key] = make()
    return box[key]


def worker_slot(key, make):
    """Like worker_cache for large objects: a process keeps the last one only."""
    box = sys.__dict__.setdefault("_searchloom_slot", {})
    if key not in box:
        box.clear()
        box[key] = make()
    return box[key]


def trimmed(run):
    """run, a function of Arrow batches, giving memory back to the system when a
    task ends: workers live on, and what they keep counts against the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def flat_bytes(col):
    """(uint8 data, int64 offsets) of an Arrow string or binary array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        empty = b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""
        col = pc.fill_null(col, empty)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(off[0])
    return buf[lo : int(off[-1])], off - lo


def powers(n: int):
    """(BASE**i, BASE**-i) for i up to n."""
    size = SEGMENT
    while size < n:
        size *= 2

    def make():
        up, down = np.full(size + 1, BASE, U64), np.full(size + 1, BASE_INV, U64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)

    return worker_cache(("powers", size), make)


def byte_values():
    """A random 64-bit value for each byte; the seed is fixed."""
    return worker_cache("byte_values", lambda: np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1))


def prefix_hash(values):
    """c with c[j] - c[i] = sum of values[i:j] times powers of BASE."""
    n = len(values)
    up, _ = powers(n)
    c = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=c[1:])
    return c


def span_hash(c, start, end):
    """Hash of symbols [start, end) from prefix_hash's c; equal spans are equal anywhere."""
    _, down = powers(len(c) - 1)
    return mix((c[end] - c[start]) * down[start] + (np.asarray(end - start)).astype(U64) * U64(0xD6E8FEB86659FD93))


def mix(h):
    """A bijection that spreads every bit (splitmix64's finish)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ranges(starts, lens):
    """Concatenated aranges: starts[i], starts[i] + 1, ... of lens[i] each."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)


def segments(offsets, limit: int):
    """Row ranges (i, j) whose data is at most limit long, or that are one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
