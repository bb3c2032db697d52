"""Vectorised word handling inside Arrow tasks.

Everything here works on one Arrow batch at a time: texts arrive as one byte
buffer with offsets, words are found with array operations and represented by
64-bit hashes.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x5851F42D4C957F2D            # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64 (kept for later calls)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, U(base), dtype=U)
        have[0] = U(1)
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:           # very long single texts are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Memory that a finished step no longer uses goes back to the system; workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def space_table() -> np.ndarray:
    """Byte map: A-Z lower-cased, ASCII white space (0x20, 0x09-0x0D) -> 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 0
    t[32] = 0
    # a NUL byte is a word character here; give it a byte that UTF-8 never uses
    t[0] = 0xFF
    return t


def alnum_table() -> np.ndarray:
    """Byte map: A-Z lower-cased; 0-9, a-z and all non-ASCII bytes are word bytes, the rest -> 0."""
    t = np.zeros(256, dtype=np.uint8)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(a)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], np.int64)[a.offset:a.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Slices of a batch whose texts hold about ``limit`` bytes (one long text may hold more)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, n]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(lo), int(hi - lo))


class Words:
    """The words of a batch of texts: ``start``/``end`` (byte positions), ``doc``
    (row of the word), ``first`` (index of each row's first word, one entry more
    than rows) and ``hash``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        n_rows = len(off) - 1
        b = table[data]
        on = b != 0
        edge = np.zeros(len(b) + 1, bool)
        edge[off] = True                           # a word never crosses two texts
        before = np.empty_like(on)
        before[:1] = False
        before[1:] = on[:-1]
        start = on & (~before | edge[:-1])
        after = np.empty_like(on)
        after[-1:] = False
        after[:-1] = on[1:]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(on & (~after | edge[1:])) + 1
        self.bytes = b
        count = np.searchsorted(self.start, off)
        self.first = count.astype(np.int64)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(n_rows), self.n)
        if len(self.start):
            rel = powers(_BASE, len(b) + 1)
            summed = np.add.reduceat(b * rel[:len(b)], self.start)
            self.hash = mix(summed * powers(_BASE_INV, len(b) + 1)[self.start])
        else:
            self.hash = np.zeros(0, U)

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i]:self.end[i]].tobytes()


def windows(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of every run of ``k`` values of ``h`` (run ``i`` starts at ``i``); ``len(h)-k+1`` of them."""
    if len(h) < k:
        return np.zeros(0, U)
    total = np.empty(len(h) + 1, U)
    total[0] = 0
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    inv = powers(pow(base, -1, 1 << 64), len(h) - k + 1)
    return mix((total[k:] - total[:-k]) * inv)


def inside(first: np.ndarray, n: np.ndarray, k: int, length: int) -> np.ndarray:
    """For runs of ``k`` over the concatenated words: True where the run stays within one text."""
    ok = np.zeros(max(length - k + 1, 0), bool)
    if not len(ok):
        return ok
    room = np.maximum(n - k + 1, 0)
    delta = np.zeros(len(ok) + 1, np.int64)
    has = room > 0
    np.add.at(delta, first[:-1][has], 1)
    np.add.at(delta, (first[:-1] + room)[has], -1)
    return np.cumsum(delta[:-1]) > 0


def shift_all(values: np.ndarray) -> np.ndarray:
    """uint64 values as the int64 that Spark holds."""
    return values.view(np.int64)
