"""Texts of an Arrow batch as flat numpy arrays.

A block of texts is one byte array and ``n + 1`` offsets.  Words, lines and
their 64-bit hashes are found for all texts of the block at once; no function
looks at one text at a time.  Memory is a fixed multiple of the block, which
holds about ``BLOCK_BYTES`` or, where a single text is longer, that text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U) | U(1)


BYTE_VALUES = _byte_table(20240501)
BYTE_VALUES_2 = _byte_table(77003)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CHAR_START = (np.arange(256) & 0xC0) != 0x80


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``m**i`` and ``m**-i`` modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_MUL, _INV)):
            p = np.full(n, m, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """c with ``span_hashes`` of any span of ``values`` from two look-ups."""
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=c[1:])
    return c


def span_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span ``values[start:end]`` from the prefix hashes; equal content, equal hash."""
    inverse = powers(len(c))[1]
    return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive blocks of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` within each text, and the index of each text's first run."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (split at \\n; an empty text is one empty line) and the index of each text's first line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    return starts, ends, first


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the text of each item, from each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def counts_before(mask: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the items of each text."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
