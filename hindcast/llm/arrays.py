"""Texts of an Arrow column as numpy arrays: bytes, word spans and hashes, no Python object per word.

A word is a run of bytes other than space and U+0009 to U+000D.  All hashes are
64-bit polynomials of the bytes with a final mix; they are the same in every
process and at every position, so they serve as shuffle keys.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))
Batches = Iterator[pa.RecordBatch]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * SLICE:  # tables for one very long text are not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def give_back() -> None:
    """Return what the allocators of this process hold unused to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others may not
    if trim:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, giving memory back before, between and after its batches.

    Workers outlive tasks, and what one stage freed would count beside the next one.
    """

    def whole(batches: Batches) -> Batches:
        def fed() -> Batches:
            for batch in batches:
                give_back()
                yield batch

        yield from run(fed())
        give_back()

    return whole


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of ``most`` bytes; a longer text comes alone.

    Nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        own = offsets[row : end + 1]
        yield row, data[own[0] : own[-1]], own - own[0]
        row = end


def spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text (plus one) the number of words before it."""
    solid = ~gap[buf]
    first, last = solid.copy(), solid.copy()
    if len(buf):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[(offsets > 0) & (offsets < len(buf))]
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the lines (cut at \n, empty ones included), and the lines before each text."""
    breaks = np.flatnonzero(buf == 10)
    n = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return starts, ends, np.arange(n + 1) + np.searchsorted(breaks, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span of bytes."""
    power, inverse = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def sequences(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run of word hashes."""
    power, inverse = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], dtype=np.uint64, out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def of_text(before: np.ndarray) -> np.ndarray:
    """The text of each word, given the words before each text."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def grams(words: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row inside one text, the first word of each, and the number before each text."""
    per = np.maximum(np.diff(before) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(out[-1]) + np.repeat(before[:-1] - out[:-1], per)
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = total * np.uint64(_BASE) + words[at + i]
    return mixed(total + np.uint64(k)), at, out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
