"""Vectorised word access over Arrow string columns.

An Arrow string column already is one byte buffer plus offsets. The helpers
here find words, hash them and cut n-grams on that buffer with numpy, so no
Python string is made for a word. Every helper takes whole texts; ``blocks``
only bounds how many rows are worked on at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers of two independent polynomial hashes, with their inverses.
_BASES = [(np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPAN = 1 << 18
_powers: dict[str, np.ndarray] = {}

#: Byte tables: ASCII lower case; white space; letters and digits (all bytes
#: of non-ASCII characters count as letters).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function over batches that gives back its memory at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        size = np.diff(off)
        null = np.asarray(column.is_null())
        if size[null].any():
            return text_buffer(column.fill_null(""))
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of a single longer row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """Words of a block: byte ranges in ``data``, and the row of each."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of the first word of each row, and the total at the end."""
        return np.searchsorted(self.row, np.arange(len(self.off)))


def find_words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes that ``table`` accepts, never across two rows."""
    ok = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty_like(ok)
    after = np.empty_like(ok)
    if len(ok):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = ok[:-1], ok[1:]
        before[edge[:-1]] = False
        after[edge[1:]] = False
    start = np.flatnonzero(ok & ~before)
    end = np.flatnonzero(ok & ~after) + 1
    return Words(data, off, start, end, np.searchsorted(off, start, "right") - 1)


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, _SPAN + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * _SPAN:
            _powers[kind] = have
    return have


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each byte range; ranges ascend and don't overlap.

    which: 0 or 1, two hashes with different multipliers.
    """
    up, down = _BASES[which]
    out = np.empty(len(start), np.uint64)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + _SPAN, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        part = data[lo:hi].astype(np.uint64) + np.uint64(1)
        size = len(part)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(part * _power(f"up{which}", up, size)[:size], out=sums[1:], dtype=np.uint64)
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _power(f"down{which}", down, size)[s]
        i = j
    return mix(out)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h + np.uint64(salt * 2 + 1)) * _MIX
    h ^= h >> np.uint64(32)
    return h * _MIX


def bucket(h: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """Feature index of ``bits`` bits from a hash."""
    return (mix(h, salt) >> np.uint64(64 - bits)).astype(np.int64)


def prefix_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Hash of the first ``width`` bytes of each word (all of a shorter one)."""
    out = np.zeros(len(start), np.uint64)
    top = len(data) - 1
    for k in range(width):
        at = start + k
        byte = np.where(at < end, data[np.minimum(at, top)], 0).astype(np.uint64) if top >= 0 else out
        out |= byte << np.uint64(8 * (k % 8))
        if k % 8 == 7:
            out = mix(out, k)
    return mix(out, width)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (n + 1 values)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows on axis 0) between consecutive ``first`` indexes; empty ranges give 0."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def row_max(values: np.ndarray, first: np.ndarray, empty: float) -> np.ndarray:
    out = np.full(len(first) - 1, empty, np.float64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, first[full])
    return out
