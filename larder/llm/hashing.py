"""64-bit hashes of many substrings at once: a polynomial over bytes modulo 2^64, and mixing."""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15
MIXES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


@functools.lru_cache(maxsize=4)
def powers(size: int):
    """Powers of the base and of its inverse modulo 2^64, as many as a block of text may need."""
    def table(base: int):
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    return table(BASE), table(pow(BASE, -1, 1 << 64))


def mixed(h, turn: int = 0):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIXES[turn])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIXES[(turn + 1) % len(MIXES)])
    return h ^ (h >> np.uint64(32))
