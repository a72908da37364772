"""Vectorised word hashing over Arrow string arrays, shared by the operators.

A *word* is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the text (lower-cased unless said otherwise).  Words are never
turned into Python strings: the UTF-8 buffer is classified byte by byte and a
polynomial hash modulo 2**64 is read off prefix sums, so the cost is a few
numpy passes over the bytes of the *whole* text, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1

WORD_BYTES = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    WORD_BYTES[_lo:_hi] = True

SOLID_BYTES = np.ones(256, dtype=bool)
SOLID_BYTES[[9, 10, 11, 12, 13, 32]] = False

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _BLOCK_BYTES + (1 << 16))
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.empty(size, dtype=U)
            table[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                table[filled : filled + step] = table[:step] * U(pow(base, filled, 1 << 64))
                filled += step
            out.append(table)
        _powers = (out[0], out[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def plain_strings(column: pa.Array) -> pa.Array:
    """A string array without nulls (null becomes empty) and with offset 0."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large_string array without nulls."""
    n = len(strings)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * strings.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def blocks(strings: pa.Array, limit: int = _BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer single text is a range of its own."""
    off, _ = buffers(strings)
    start, n = 0, len(strings)
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words; no word crosses a text's end."""
    if len(data) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = solid[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte range; equal bytes give equal hashes wherever they stand."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of ``length`` items that begins at each start, of the items' hashes."""
    power, inverse = _power_tables(len(hashes) + 1)
    total = np.empty(len(hashes) + 1, dtype=U)
    total[0] = 0
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[starts + length] - total[starts]) * inverse[starts] + U(length))


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of the ``width`` items from each place on; fewer at the end."""
    out, done, op = x.copy(), 1, np.minimum if least else np.maximum
    while done < width and done < len(x):
        k = min(done, width - done)
        out[:-k] = op(out[:-k], out[k:])
        done += k
    return out


def word_hashes(strings: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, word offsets by text) of plain strings."""
    hashes, offsets, base = [], [np.zeros(1, dtype=np.int64)], 0
    for start, stop in blocks(strings):
        part = strings.slice(start, stop - start)
        off, data = buffers(pc.utf8_lower(part) if lower else part)
        first, end = spans(data, off)
        hashes.append(range_hashes(data, first, end))
        offsets.append(np.searchsorted(first, off[1:]) + base)
        base += len(first)
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=U)), np.concatenate(offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``n`` words, offsets by text).

    A text of fewer than ``n`` words has one shingle, all its words; a text
    without words has none.
    """
    counts = np.diff(offsets)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_off = np.concatenate([[0], np.cumsum(size)])
    total = int(out_off[-1])
    starts = np.repeat(offsets[:-1], size) + np.arange(total) - np.repeat(out_off[:-1], size)
    length = np.repeat(np.minimum(counts, n), size)
    acc = np.zeros(total, dtype=U)
    padded = np.concatenate([words, np.zeros(n, dtype=U)])
    for k in range(n):
        acc = np.where(length > k, mix(acc * U(0x9FB21C651E98DF25) + padded[starts + k] + U(k + 1)), acc)
    return acc, out_off
