"""crc32 of runs of words, over numpy arrays.

The checksum of a text is a linear function of that of its beginning and of its
end, so runs are put together from the checksums of their words, and no run is
ever spelt out.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Fixed value: the reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320
#: Words up to this length are checked side by side, longer ones one by one.
SHORT = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


TABLE = _byte_table()


def _mapped(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, as four tables of 256, of 32-bit numbers."""
    return op[0][x & 255] ^ op[1][(x >> 8) & 255] ^ op[2][(x >> 16) & 255] ^ op[3][x >> 24]


def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps that put 0 to 63 zero bytes, and 64 times a power of two of them, behind a text."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    few = [one]
    for _ in range(64):
        one = TABLE[one & 255] ^ (one >> 8)
        few.append(one)
    many = [few[64]]
    while len(many) < 26:
        many.append(np.stack([_mapped(many[-1], many[-1][k]) for k in range(4)]))
    return np.stack(few[:64]), many


FEW, MANY = _maps()


def behind(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a checksum that comes from a text with *length* bytes behind it."""
    low = length & 63
    out = FEW[low, 0, crc & 255] ^ FEW[low, 1, (crc >> 8) & 255] ^ FEW[low, 2, (crc >> 16) & 255] ^ FEW[low, 3, crc >> 24]
    high = length >> 6
    k = 0
    while high.any():
        rows = np.flatnonzero(high & 1)
        if len(rows):
            out[rows] = _mapped(MANY[k], out[rows])
        high, k = high >> 1, k + 1
    return out


def word_checksums(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of *raw*."""
    length = end - start
    turn = np.argsort(-np.minimum(length, SHORT + 1), kind="stable")
    sizes = length[turn]
    out = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    first = start[turn]
    at = int((sizes > SHORT).sum())
    for j in range(int(sizes[at]) if at < len(sizes) else 0):
        upto = at + int(np.searchsorted(-sizes[at:], -j, side="left"))
        now = out[at:upto]
        out[at:upto] = TABLE[(now ^ raw[first[at:upto] + j]) & 255] ^ (now >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(at):
        out[i] = zlib.crc32(raw[first[i] : first[i] + sizes[i]])
    back = np.empty_like(out)
    back[turn] = out
    return back


def spans(raw: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word by row) of the words of consecutive rows; bounds[0] is 0."""
    inside = ~separator[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, bounds)


def run_checksums(raw: np.ndarray, start: np.ndarray, end: np.ndarray, most: int):
    """For 1 to *most* words: the crc32 of each run of so many words with one space between, by its first word.

    Runs go on across rows; the caller leaves out those that do.
    """
    length = end - start
    own = word_checksums(raw, start, end)
    space = np.uint32(zlib.crc32(b" "))
    ones = np.ones(len(own), dtype=np.int64)
    run = own
    yield run
    for k in range(1, most):
        n = max(len(own) - k, 0)
        spaced = behind(run[:n], ones[:n]) ^ space
        run = behind(spaced, length[k : k + n]) ^ own[k : k + n]
        yield run
