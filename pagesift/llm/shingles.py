"""Word shingles as sets of 64-bit hashes, and circulant MinHash signatures of such sets."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: A worker's cache of word hashes is emptied at this size.
MOST_WORDS = 100_000
_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a whole text, sorted. A-Z count as a-z; words are parted by ASCII white space;
    fewer words than a shingle make one shingle together; a text without words has none."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > MOST_WORDS:
        _WORDS.clear()
    known, h = _WORDS, xxhash.xxh3_64_intdigest
    hashes = np.array([known.get(t) or known.setdefault(t, h(t)) for t in tokens], np.uint64)
    k = min(words, len(tokens))
    out = np.full(len(tokens) - k + 1, k, np.uint64)
    for i in range(k):  # wraps around on purpose
        out ^= hashes[i : len(tokens) - k + 1 + i]
        out *= U(0x9E3779B97F4A7C15)
        out ^= out >> U(32)
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the minimum of pi(sigma(x) + k mod 2**32): sigma breaks up structure once, and one
    permutation pi, shifted by k, stands for the k-th of as many independent ones."""
    x = (shingles ^ (shingles >> U(32))).astype(np.uint32)
    x *= np.uint32(0x9E3779B1)
    x = _mix(x)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 256):
        np.minimum(best, _mix(x[None, a : a + 256] + shifts).min(1), out=best)
    return best


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    out = np.zeros(len(signature) // rows, np.uint64)
    for r in range(rows):
        out ^= signature[r::rows][: len(out)].astype(np.uint64) + U(r)
        out *= U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
    return out.view(np.int64)


def bitmap(shingles: np.ndarray, words: int) -> np.ndarray:
    """A set as ``words`` 64-bit words, with the bit set that a shingle's lowest bits name."""
    bits = np.zeros(64 * words, np.uint8)
    bits[shingles & U(64 * words - 1)] = 1
    return np.packbits(bits).view(np.int64)
