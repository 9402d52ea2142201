"""Vectorised text kernels: words, segments, and 64-bit hashes of many pieces of bytes at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
MULT = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that is one-to-one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; the position of a piece has no influence.

    A piece is read as words of 8 bytes; each is mixed with its number, and the mixed words are added up. Pieces of
    at most 8 bytes never share a hash with one another; no sums cancel by the structure of a text."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    count = (size + 7) >> 3
    first = np.cumsum(count) - count
    number = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(first, count)
    left = np.minimum(np.repeat(size, count) - 8 * number, 8)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    at_each_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    block = at_each_byte[np.repeat(starts, count) + 8 * number] & FIRST[left]
    block = mix(block + MULT[0]) + number.astype(np.uint64) * MULT[6]
    some = count > 0
    total = np.zeros(len(starts), np.uint64)
    if some.any():
        total[some] = np.add.reduceat(mix(block), first[some])
    return mix(total ^ (size.astype(np.uint64) * MULT[5]))


def words(data: np.ndarray, doc_starts: np.ndarray, is_gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without gap bytes; runs end where a document ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~is_gap[data]
    step = np.diff(inside)
    cut = doc_starts[(doc_starts > 0) & (doc_starts < len(data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        starts, ends = np.sort(np.r_[starts, np.unique(cut)]), np.sort(np.r_[ends, np.unique(cut)])
    return starts, ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start..start+length-1 of all pieces, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def segments(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of segments that a pre-tokenizer can treat one by one.

    A segment begins at a document's start, and at each space or line feed that follows a character
    other than white space (of any kind, Unicode included).
    """
    n = len(data)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at > 0]
    p1, p2, p3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    wide |= (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
    wide |= (p3 == 0xE2) & (((p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))) | ((p2 == 0x81) & (p1 == 0x9F)))
    wide |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    mark = np.zeros(n + 1, bool)
    mark[at[((p1 > 0x20) & (p1 < 0x7F)) | ((p1 >= 0x80) & ~wide)]] = True
    mark[doc_starts] = True
    return np.flatnonzero(mark[:n])


def shingles(data: np.ndarray, off: np.ndarray, width: int = 5):
    """For each document (off: its bounds in data) the sorted distinct hashes of its word shingles.

    Words are runs without white space, A-Z lower-cased. A document of fewer words than `width` has its
    whole sequence as one shingle; one without words has none.
    """
    starts, ends = words(data, off[:-1])
    hashes = piece_hashes(LOWERED[data], starts, ends)
    first = np.searchsorted(starts, off)
    n = len(hashes)
    if n >= width:
        all_ = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            all_ += hashes[k : n - width + 1 + k] * MULT[k + 1]
        all_ = mix(all_)
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.sort(all_[a : b - width + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif b > a:
            part = np.uint64([b - a]) * MULT[7] + (hashes[a:b] * MULT[1 : 1 + b - a]).sum(keepdims=True)
            yield mix(part)
        else:
            yield np.zeros(0, np.uint64)
