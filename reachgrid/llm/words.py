"""Words of whole texts as numpy arrays: places, rows and 64-bit hashes.

All functions run inside Arrow tasks. Texts are handled as UTF-8 bytes in
slices, so memory is bounded by the slice and by the bytes of the longest single
text; a word longer than a slice is hashed in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 16
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit arrays."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


STEP = 0x9E3779B97F4A7C15
BYTE = mix(np.arange(1, 257, dtype=U) * U(STEP))
FACTORS = mix(np.arange(1001, 1065, dtype=U) * U(STEP)) | U(1)
RADIX = int(mix(np.array([77], dtype=U))[0]) | 1
INVERSE = pow(RADIX, -1, 1 << 64)

#: The two separator sets, as 256 flags: white space, and all ASCII but digits and letters.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers for places inside a slice.
UP, DOWN = _powers(RADIX, SLICE + 1), _powers(INVERSE, SLICE + 1)


def _long_sum(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum over the bytes of one long word, by parts of a slice."""
    total = 0
    for at in range(0, len(values), SLICE):
        part = table[values[at : at + SLICE]]
        total += int((part * UP[: len(part)]).sum(dtype=U)) * pow(RADIX, at, 1 << 64)
    return np.array([total % (1 << 64)], dtype=U)


@dataclass
class Words:
    """Words of a slice: byte span, row of the slice and hash of each; first[r]:first[r+1] are those of row r."""

    raw: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    bounds = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(bounds) else raw[:0], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about *size* bytes; a longer row stands alone."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(raw: np.ndarray, bounds: np.ndarray, separator: np.ndarray, fold: np.ndarray, kinds: np.ndarray | None = None) -> Words:
    """Words of consecutive rows; *bounds* are the rows' byte bounds in *raw*.

    With *kinds* a word also ends between a byte of kind 1 and one of kind 2.
    """
    base = int(bounds[0])
    raw, bounds = raw[base : int(bounds[-1])], bounds - base
    n = len(raw)
    inside = ~separator[raw]
    table = BYTE[fold]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    if kinds is not None and n > 1:
        kind = kinds[raw]
        between = kind[:-1] * kind[1:] == 2
        closes[:-1] |= between
        opens[1:] |= between
    cuts = bounds[(bounds > 0) & (bounds < n)]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(start), dtype=U)
    done = 0
    while done < len(start):
        # By about SLICE bytes of words at a time, for the memory of the running sums.
        upto = int(np.searchsorted(end, start[done] + SLICE, side="right"))
        low, high = int(start[done]), int(end[max(upto - 1, done)])
        if upto == done:
            hashes[done] = mix(_long_sum(raw[low:high], table) + U((high - low) * STEP % (1 << 64)))[0]
            done += 1
            continue
        total = np.zeros(high - low + 1, dtype=U)
        np.cumsum(table[raw[low:high]] * UP[: high - low], out=total[1:])
        s, e = start[done:upto] - low, end[done:upto] - low
        hashes[done:upto] = mix((total[e] - total[s]) * DOWN[s] + (e - s).astype(U) * U(STEP))
        done = upto
    return Words(raw, bounds, start, end, hashes, np.searchsorted(start, bounds))


def read_words(column: pa.Array, separator: np.ndarray, fold: np.ndarray = LOWER) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) by slices of a column."""
    raw, bounds = bytes_of(column)
    for i, j in slices(bounds):
        yield i, j, words_of(raw, bounds[i : j + 1], separator, fold)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of *k* words of one sequence, in order; one for the whole of a shorter one."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    total = hashes[: n - width + 1] * FACTORS[0]
    for j in range(1, width):
        total = total + hashes[j : n - width + 1 + j] * FACTORS[j]
    return mix(total + U(width))


def text_grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of the runs of *k* words of each row of a slice."""
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    whole = grams(words.hash, k) if len(words.hash) >= k else words.hash[:0]
    # A run that starts in the last k - 1 words of its row reaches into the next one.
    left = np.repeat(words.first[1:], count) - np.arange(len(words.hash))
    keep = left >= k
    bounds = np.concatenate([[0], np.cumsum(np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype)))])
    out = np.empty(bounds[-1], dtype=U)
    at = np.ones(len(out), dtype=bool)
    at[bounds[:-1][short]] = False
    out[at] = whole[np.flatnonzero(keep[: len(whole)])] if len(whole) else whole
    for c in range(1, k):
        rows = short[count[short] == c]
        if len(rows):
            total = sum((words.hash[words.first[rows] + j] * FACTORS[j] for j in range(1, c)), words.hash[words.first[rows]] * FACTORS[0])
            out[bounds[rows]] = mix(total + U(c))
    return out, bounds


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], type=pa.binary())


def longs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list<int64> column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int64)))
