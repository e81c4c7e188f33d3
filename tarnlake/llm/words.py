"""Words of many texts at once, as 64-bit hashes, in numpy.

A word is a maximal run of bytes other than space and the bytes 9 to 13; A-Z count as a-z. A word's hash is the
sum of one fixed random number per (byte, position), finished with a mixing step, so equal words have equal hashes
everywhere and different words differ but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SLOTS = 64
RANDOM = np.random.PCG64(7151).random_raw(SLOTS * 256).astype(np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    hashes: np.ndarray  #: of each word, uint64
    offsets: np.ndarray  #: n + 1 positions in hashes, by text
    values: np.ndarray  #: of each byte of each word, uint64
    begins: np.ndarray  #: of each word in values
    lengths: np.ndarray  #: of each word in bytes
    raw: np.ndarray  #: the words' bytes in lower case, joined


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing step on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """data: the bytes of the texts, end to end; off: their n + 1 offsets."""
    zero = np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    if len(data) > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    head, tail = off[:-1][full], off[1:][full] - 1
    first[head], last[tail] = inside[head], inside[tail]
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, off)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), at, np.zeros(0, np.uint64), zero, zero, np.zeros(0, np.uint8))
    lengths = np.flatnonzero(last) + 1 - starts
    begins = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=begins[1:])
    raw = LOWER[data[inside]]
    place = np.arange(len(raw)) - np.repeat(begins, lengths)
    values = RANDOM[((place & (SLOTS - 1)) << 8) | raw]
    if lengths.max() > SLOTS:
        turn = place // SLOTS
        power = np.cumprod(np.full(int(turn.max()) + 1, STEP | np.uint64(1)))
        later = np.flatnonzero(turn)
        values[later] *= power[turn[later]]
    return Words(mix(np.add.reduceat(values, begins)), at, values, begins, lengths, raw)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `size` words inside a text, and n + 1 offsets. A shorter text with words is one run."""
    n = np.diff(w.offsets)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=off[1:])
    total = int(off[-1])
    if not total:
        return np.zeros(0, np.uint64), off
    at = np.arange(total) - np.repeat(off[:-1], counts) + np.repeat(w.offsets[:-1], counts)
    end = np.repeat(w.offsets[1:], counts)
    h = np.full(total, np.uint64(size))
    for k in range(size):
        there = at + k < end
        word = np.where(there, w.hashes[np.minimum(at + k, len(w.hashes) - 1)], np.uint64(0))
        h = mix(h * STEP + word)
    return h, off
