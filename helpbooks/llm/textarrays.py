"""Whole Arrow batches of texts as numpy arrays: words, word hashes, shingle hashes.

Words are the maximal runs of bytes other than space, tab, LF, VT, FF and CR
after lower-casing A-Z. Hashes have 64 bits and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are turned into arrays at a time (a single text may exceed it).
SLICE_BYTES = 2_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of an Arrow binary array without nulls."""
    n = len(column)
    if not n:
        return
    kind = np.int64 if "large" in str(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word; a word never crosses two texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside[:-1] & (~inside[1:] | first[1:])
    end = np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return start, end, text


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (lower-cased) words of a byte array."""
    n = len(data)
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[LOWER[data]] * powers(_INVERSE, n), out=total[1:])
    length = (end - start).astype(U64)
    return mix((total[end] - total[start]) * powers(_BASE, n)[start] + length * U64(0xA24BAED4963EE407))


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in text order, offsets by text). A text of fewer words has one shingle, all of them; one without words has none."""
    count = np.bincount(text, minlength=n_texts)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(size)])
    if not offsets[-1]:
        return np.zeros(0, U64), offsets
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    owner = np.repeat(np.arange(n_texts), size)
    at = np.arange(offsets[-1]) - offsets[owner] + begin[owner]
    padded = np.concatenate([hashes, np.zeros(width, U64)])
    out = np.zeros(len(at), U64)
    left = count[owner]
    for k in range(width):
        out = out * U64(0x9FB21C651E98DF25) + np.where(left > k, padded[at + k], U64(0))
        out ^= out >> U64(29)
    return mix(out + np.minimum(left, width).astype(U64)), offsets


def text_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    start, end, text = words(data, offsets)
    return shingles(word_hashes(data, start, end), text, len(offsets) - 1, width)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole texts, byte by byte."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(_INVERSE, n), out=total[1:])
    start, end = offsets[:-1], offsets[1:]
    return mix((total[end] - total[start]) * powers(_BASE, n + 1)[start] + (end - start).astype(U64))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n odd 64-bit multipliers, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(salt)) | U64(1)


def permuted(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    """32-bit values of one random order of the hashes."""
    return ((h * seed) >> U64(32)).astype(np.uint32)
