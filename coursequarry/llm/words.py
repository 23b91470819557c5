"""Words and word windows of whole texts as 64-bit hashes, in numpy.

A word is a run of bytes other than space and \\x09-\\x0D of the UTF-8 text. Word and window hashes are
polynomial sums modulo 2**64 taken from running sums, so a block of texts costs a few passes over its bytes
whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and its inverses modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        have = _powers[int(base)] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each row; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of the first word of every row (one more at the end)."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    is_word = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
                block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of the first word of every row (one more at the end)."""
    parts, firsts, total = [], [np.zeros(1, np.int64)], 0
    for i, j in row_blocks(offsets, block):
        lo, hi = offsets[i], offsets[j]
        own = data[lo:hi]
        if lower:
            own = _LOWER[own]
        starts, ends, first = spans(own, offsets[i:j + 1] - lo)
        up, down = powers(_BYTE_BASE, len(own) + 1)
        sums = _running((own.astype(np.uint64) + np.uint64(1)) * up[:len(own)])
        h = (sums[ends] - sums[starts]) * down[starts]
        parts.append(mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        firsts.append(first[1:] + total)
        total += len(starts)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(firsts)


def window_hashes(words: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `length` words inside one row, and the word number where each starts."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + length <= ends[:n])
    if length <= 8:
        h = np.zeros(len(at), np.uint64)
        for k in range(length):
            h = h * _WORD_BASE + words[at + k]
    else:
        up, down = powers(_WORD_BASE, len(words) + 1)
        sums = _running(words * up[:len(words)])
        h = (sums[at + length] - sums[at]) * down[at]
    return mix(h + np.uint64(length)), at


def shingle_hashes(words: np.ndarray, first: np.ndarray, length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles and the row of each; a row of fewer words has its whole sequence as its only one."""
    h, at = window_hashes(words, first, length)
    row = np.searchsorted(first, at, "right") - 1
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < length))
    if len(short):
        more = np.array([int(mix(np.array([_fold(words[first[r]:first[r + 1]])], np.uint64))[0]) for r in short], np.uint64)
        h, row = np.concatenate([h, more]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def _fold(words: np.ndarray) -> int:
    h = 0
    for w in words.tolist():
        h = (h * int(_WORD_BASE) + w) & (2**64 - 1)
    return (h + len(words)) & (2**64 - 1)
