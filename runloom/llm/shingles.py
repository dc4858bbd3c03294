"""Words of texts as hashes, and labelled shingles of words."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0xC4CEB9FE1A85EC53)
# Bytes that belong to a word: ASCII letters and digits, and all of the longer characters.
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(lowered: bytes) -> np.ndarray:
    """One 64-bit hash per word of a lower-cased UTF-8 text."""
    data = np.frombuffer(lowered.translate(_KEEP), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = data != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[stop] - sums[first]) * down[first]
               + (stop - first).astype(np.uint64) * _STEP)


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hash of every run of ``k`` words; a shorter text is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * _STEP + words[i:len(words) - k + 1 + i]
        out = out ^ (out >> np.uint64(31))
    return mix(out)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each value mixed with the number of its earlier occurrences, so that all differ."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return values
    at = np.arange(len(values))
    count = np.empty(len(values), np.int64)
    count[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(count > 0, mix(values + count.astype(np.uint64) * _MIX), values)
