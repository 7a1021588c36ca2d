"""64-bit hashes of words and shingles over UTF-8 bytes, vectorised per text and in blocks for very long ones."""
from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """PRIME to the powers 0 to n - 1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1024) - 1, PRIME, np.uint64))))
    return _powers[:n]


def _block_hashes(b: np.ndarray) -> np.ndarray:
    inside = ~SPACE[b]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    spot = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        terms = BYTE_VALUE[b[inside]] * powers(int(lengths.max()))[spot]
        return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * PRIME)


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+`` in text order; ``lower`` folds A-Z."""
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = LOWER[b]
    if len(b) <= BLOCK:
        return _block_hashes(b)
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + BLOCK)
        while end < len(b):  # a word is never cut
            gap = np.flatnonzero(SPACE[b[end:end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(len(b), end + BLOCK)
            if len(gap):
                break
        parts.append(_block_hashes(b[at:end]))
        at = end
    return np.concatenate(parts)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per run of ``k`` words, in order."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i, p in enumerate(powers(k)):
            total += words[i:i + n] * p
        return mix(total + np.uint64(k) * PRIME)


def shingle_set(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles of ``k`` lower-cased words; a shorter text is one shingle, an empty one none."""
    words = word_hashes(data, lower=True)
    return np.unique(window_hashes(words, min(k, len(words)) or 1))
