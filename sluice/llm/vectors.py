"""Words and shingles of Arrow string columns as numpy hashes.

Everything works on the UTF-8 bytes of many texts at once. Words are runs of
digits, ASCII letters (A-Z as a-z) and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are taken in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n 64-bit numbers that depend on seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


_CLASS = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _CLASS[_b] = _b
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTE = stream(1, 256)
_STEP = int(stream(2, 1)[0]) | 1
_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.empty(max(n, 64), U64)
        p[0] = 1
        p[1:] = U64(_STEP)
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(p)
    return _POWERS


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def groups(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, bytes, offsets of groups of neighbouring texts of about GROUP_BYTES."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


#: Classes for words between blanks: every other byte, A-Z as a-z.
UNSPACED = np.arange(256, dtype=np.uint8)
UNSPACED[0x41:0x5B] = np.arange(0x61, 0x7B)
UNSPACED[[0x20, *range(0x09, 0x0E)]] = 0
UNSPACED[0] = 0xFF  # a byte that no UTF-8 text has


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = _CLASS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the n + 1 places at which the texts' words start.

    classes gives for each byte what it counts as, or 0 if it parts words.
    """
    cls = classes[data]
    inside = cls != 0
    fresh = np.ones(len(data), bool)
    np.logical_not(inside[:-1], out=fresh[1:])
    ends = offsets[1:-1]
    fresh[ends[ends < len(data)]] = True
    starts = np.flatnonzero(inside & fresh)
    upto = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), upto
    letters = cls[inside]
    before = np.cumsum(inside, dtype=np.int64)
    at = before[starts] - 1
    lengths = np.diff(at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[letters] * _powers(int(lengths.max()))[place], at)
        return mix(sums + lengths.astype(U64)), upto


def shingles(words: np.ndarray, upto: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of `size` words, and where each text's start.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    n = np.diff(upto)
    counts = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    places = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        total = len(words)
        if total == 0:
            return np.zeros(0, U64), places
        padded = np.concatenate([words, np.zeros(size, U64)])
        run = np.zeros(total, U64)
        for i in range(size):
            run = run * U64(_STEP) + padded[i : i + total]
        owner = np.repeat(np.arange(len(n)), counts)
        at = upto[owner] + (np.arange(places[-1]) - places[owner])
        out = run[at]
        for d in np.flatnonzero((n > 0) & (n < size)):
            value = U64(n[d])
            for w in words[upto[d] : upto[d + 1]]:
                value = value * U64(_STEP) + w
            out[places[d]] = value
        return mix(out), places
