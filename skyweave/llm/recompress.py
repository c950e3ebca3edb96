"""Recompression of word sequences: rounds that name runs and pairs, so equal passages get equal interior symbols.

Names are hashes, so they agree across all documents and tasks without a dictionary. Every symbol knows its reach, the
words that settle it: wherever those words stand, that symbol stands. A window of words is represented by one of the
symbols whose reach lies inside it (the highest level first, then the smallest name), so equal windows, anywhere, are
represented by equal symbols at equal places.
"""

from __future__ import annotations

import numpy as np

#: Rounds of naming; the longest run that is named; the words a representative may reach over.
ROUNDS, RUN, REACH = 2, 4, 12
_A = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(24)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over an array."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Symbols:
    """A level: names, and the reach [lo, hi) of each in words."""

    def __init__(self, words: np.ndarray):
        self.name, self.lo, self.hi = words, np.arange(len(words)), np.arange(1, len(words) + 1)

    def runs(self) -> None:
        """Name runs of 2 to RUN equal symbols; longer runs stay as they are."""
        name, lo, hi, n = self.name, self.lo, self.hi, len(self.name)
        starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        sizes = np.diff(np.r_[starts, n])
        # A run is settled by its members and both neighbours, whose reaches needn't be in order.
        near_lo, near_hi = lo.copy(), hi.copy()
        np.minimum(near_lo[1:], lo[:-1], out=near_lo[1:])
        np.minimum(near_lo[:-1], lo[1:], out=near_lo[:-1])
        np.maximum(near_hi[1:], hi[:-1], out=near_hi[1:])
        np.maximum(near_hi[:-1], hi[1:], out=near_hi[:-1])
        short = sizes <= RUN
        named = np.where(sizes > 1, mix(name[starts] * _A + sizes.astype(np.uint64)), name[starts])
        run_lo, run_hi = np.minimum.reduceat(near_lo, starts), np.maximum.reduceat(near_hi, starts)
        if short.all():
            self.name, self.lo, self.hi = named, run_lo, run_hi
            return
        keep = np.repeat(~short, sizes)  # members of long runs stay, settled by RUN more on either side or the run's end
        keep[starts] = True
        at = np.flatnonzero(keep)
        which = np.repeat(np.arange(len(starts)), sizes)[at]
        long = ~short[which]
        own_lo, own_hi = lo[at], hi[at]
        for k in range(-RUN, RUN + 1):
            beside = np.clip(at + k, np.maximum(starts[which] - 1, 0), np.minimum(starts[which] + sizes[which], n - 1))
            own_lo, own_hi = np.minimum(own_lo, lo[beside]), np.maximum(own_hi, hi[beside])
        self.name = np.where(long, name[at], named[which])
        self.lo, self.hi = np.where(long, own_lo, run_lo[which]), np.where(long, own_hi, run_hi[which])

    def pairs(self, salt: int) -> None:
        """Name neighbours whose coins fall 0 and 1; other symbols are settled by the neighbour that didn't pair."""
        name, lo, hi, n = self.name, self.lo, self.hi, len(self.name)
        coin = (mix(name ^ np.uint64(salt)) >> np.uint64(63)).astype(bool)
        first = np.zeros(n, dtype=bool)
        first[:-1] = ~coin[:-1] & coin[1:]
        second = np.r_[False, first[:-1]]
        to = np.arange(n)
        other = np.where(coin & ~second, np.maximum(to - 1, 0), np.minimum(to + 1, n - 1))
        lo, hi = np.minimum(lo, lo[other]), np.maximum(hi, hi[other])
        name = np.where(first, mix(name * _A + mix(np.r_[name[1:], name[-1:]])), name)
        self.name, self.lo, self.hi = name[~second], lo[~second], hi[~second]


def representatives(words: np.ndarray, window: int) -> np.ndarray:
    """For the window at each place, the place where its representative's reach starts.

    `words` are hashes; texts in it are set apart by hashes that stand nowhere else. The representative and the REACH
    words from its place on lie inside the window. There are len(words) - window + 1 windows.
    """
    n = len(words)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    place = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    short = lambda x: (x >> np.uint64(25)) << _PLACE
    key = (np.uint64(1) << np.uint64(63)) | short(mix(words)) | (place & low)
    level = Symbols(words)
    for k in range(ROUNDS):
        level.runs()
        level.pairs(k + 1)
    fit = level.hi - level.lo <= REACH
    at = level.lo[fit]
    np.minimum.at(key, at, short(mix(level.name[fit])) | (at.astype(np.uint64) & low))
    width, size = window - REACH + 1, 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key[: n - window + 1] & low).astype(np.int64)


class Prefix:
    """Hashes of any run of words, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n, _BASE, dtype=np.uint64)
        inverse = np.full(n + 1, _INVERSE, dtype=np.uint64)
        power[:1], inverse[:1] = 1, 1
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power), dtype=np.uint64)]
        self.inverse = np.cumprod(inverse)

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])
