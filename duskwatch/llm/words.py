"""Word and shingle hashes of Arrow text columns, for numpy work inside Spark tasks.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Words of different
documents never join up. Texts are handled in pieces of about ``PIECE`` bytes so that memory
stays bounded by the batch, not by the longest document. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BATCH = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240101).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), a bijection on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1024), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    column = column.cast(pa.large_utf8()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def row_groups(offsets: np.ndarray, most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _word_bounds(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each word; ``fresh`` marks bytes at which a document begins."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | fresh[1:]
    last[:-1] &= ~word[1:] | fresh[1:]
    return np.flatnonzero(first), np.flatnonzero(last)


def word_spans(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (positions in ``buf``) of each word of rows lo..hi."""
    a, b = int(offsets[lo]), int(offsets[hi])
    fresh = np.zeros(b - a + 1, bool)
    fresh[offsets[lo:hi] - a] = True
    first, last = _word_bounds(buf[a:b], fresh[:-1])
    return first + a, last + a


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row (from 0 for ``lo``) of each word of rows lo..hi, in order.

    ``lower`` maps A-Z to a-z first and leaves all other characters. With ``prefixes``, hashes have one
    line for whole words and one for each length: of the word's first bytes, that many at most.
    """
    table = _LOWER if lower else _SAME
    a, b = int(offsets[lo]), int(offsets[hi])
    hashes, rows = [np.zeros((1 + len(prefixes), 0), np.uint64)], [np.zeros(0, np.int64)]
    at = a
    while at < b:
        end = min(at + PIECE, b)
        while end < b and not _SPACE[buf[end - 1]]:  # a piece ends with white space, at a document's end or at b
            ahead = np.flatnonzero(_SPACE[buf[end : end + 4096]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + 4096, b)
        data = table[buf[at:end]]
        fresh = np.zeros(end - at, bool)
        inside = offsets[lo:hi]
        inside = inside[(inside >= at) & (inside < end)] - at
        fresh[inside] = True
        first, last = _word_bounds(data, fresh)
        if len(first):
            sums = np.cumsum(_BYTES[data] * _power(_BASE, len(data)))
            before = np.where(first > 0, sums[first - 1], np.uint64(0))
            back = _power(pow(_BASE, -1, 2**64), len(data))[first]
            ends = [last, *(np.minimum(last, first + k - 1) for k in prefixes)]
            hashes.append(np.stack([mix((sums[e] - before) * back + (e - first + 1).astype(np.uint64)) for e in ends]))
            rows.append(np.searchsorted(offsets[lo + 1 : hi + 1], first + at, "right"))
        at = end
    found = np.concatenate(hashes, axis=1)
    return found if prefixes else found[0], np.concatenate(rows)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of k words within a row; with ``short``, a row of 1 to k-1 words gives one for all of them."""
    factors = [np.uint64((_BASE * (2 * j + 3)) % 2**64 | 1) for j in range(k)]
    out, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    m = len(words) - k + 1
    if m > 0:
        ok = np.flatnonzero(rows[:m] == rows[k - 1 :])
        value = np.full(len(ok), k, np.uint64)
        for j in range(k):
            value += words[ok + j] * factors[j]
        out.append(mix(value))
        where.append(rows[ok])
    if short and len(words):
        begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        count = np.diff(np.append(begin, len(words)))
        for size in range(1, k):
            at = begin[count == size]
            value = np.full(len(at), size, np.uint64)
            for j in range(size):
                value += words[at + j] * factors[j]
            out.append(mix(value))
            where.append(rows[at])
    return np.concatenate(out), np.concatenate(where)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
