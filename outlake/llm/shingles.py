"""Vectorised word, shingle and circulant MinHash kernels (numpy, used inside Spark tasks).

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after A-Z are lower-cased; this equals
``bytes.lower().split()``.  All kernels work on whole texts; memory is proportional to the longest text or to
``CHUNK`` bytes, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
CHUNK = 1 << 20
SHINGLE = 5
STRIP = 4096  # shingles hashed at once; their coordinates fit in the cache
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (multiply and xor-shift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | U(1)


_BYTE = _constants(11, 256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = int(_constants(12, 1)[0])
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _constants(13, SHINGLE)
_SHORT = _constants(14, SHINGLE + 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another in ``data`` (uint8).

    ``bounds`` has one more entry than there are texts.  Returns the hashes and, for each word, its text's index.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = bounds[1:][bounds[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << int(n).bit_length()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, size)[:n], out=total[1:])
    value = (total[end] - total[start]) * _powers(_INVERSE, size)[start]
    return _mix(value + (end - start).astype(np.uint64)), np.searchsorted(bounds, start, side="right") - 1


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of five-word shingles; with one to four words the whole
    sequence is the one shingle; without words or text the set is empty."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") <= CHUNK):
            size += len(texts[to] or b"")
            to += 1
        part = [x or b"" for x in texts[at:to]]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int64)
        words, owner = word_hashes(np.frombuffer(b"".join(part), np.uint8), bounds)
        where = np.searchsorted(owner, np.arange(len(part) + 1))
        if len(words) >= SHINGLE:
            run = sum(words[i : len(words) - SHINGLE + 1 + i] * _PLACE[i] for i in range(SHINGLE))
            run = _mix(run)
        for a, b in zip(where[:-1], where[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(run[a : b - SHINGLE + 1])
            elif b > a:
                yield _mix((words[a:b] * _SHORT[: b - a]).sum(keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, np.uint64)
        at = to


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell two sets apart, as two signed longs."""
    return tuple(int(_mix(s ^ U(k)).sum().astype(np.int64)) for k in (0x5BD1E995, 0x27D4EB2F165667C5))


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit words (xor-shifts and odd multiplications), in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray) -> np.ndarray:
    """Circulant MinHash: the first permutation (a bijective mix, folded to 32 bits) breaks up structure, the second
    one, its argument shifted by one place on the circle of 2 ** 32 for each coordinate, gives all coordinates."""
    place = (_mix(s + U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)
    shift = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    out = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for i in range(0, len(place), STRIP):
        np.minimum(out, _second(place[i : i + STRIP] + shift).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of four coordinates; the band's number is part of it."""
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64) + U(1)
    for i in range(ROWS):
        h = _mix(h * U(0x9E3779B97F4A7C15) + x[:, i])
    return h.astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct sets; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
