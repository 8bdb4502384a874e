"""Simple-8b: runs of integers in 64-bit words, four bits of selector and sixty of payload.

A selector says how many integers of how many bits a word holds. Selector 0 is an
escape for an integer of more than 60 bits: its payload is the integer's place in a
list of its own, so that every word can be decoded without the ones before it.
"""

from __future__ import annotations

import numpy as np

#: Integers per word and bits of each, by selector.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
#: Windows of so many integers are made of two shorter ones: (length, shorter, shift).
_WINDOWS = [
    (2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7),
    (20, 12, 8), (30, 15, 15), (60, 30, 30), (120, 60, 60),
]
_DOUBLINGS = 6


def _bits(values: np.ndarray) -> np.ndarray:
    """The number of bits of each integer, one too many for some above 2^53."""
    exponent = (values.astype(np.float64).view(np.int64) >> 52) - 1022
    return np.maximum(exponent, 0).astype(np.uint8)


def _orbit(following: np.ndarray) -> np.ndarray:
    """The places that following the array from 0 leads to, up to its end.

    Steps of 2^k are composed, the longest are followed one by one, and the places between
    are filled in level by level.
    """
    n = len(following)
    levels = [np.r_[following, n]]
    for _ in range(_DOUBLINGS):
        levels.append(levels[-1][levels[-1]])
    longest, places, at = levels.pop().tolist(), [], 0
    while at < n:
        places.append(at)
        at = longest[at]
    places = np.array(places, np.int64)
    for step in reversed(levels):
        places = np.stack([places, step[places]], axis=1).reshape(-1)
    return places[places < n]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of unsigned integers, and the escaped integers. The last word may be
    filled up with zeros."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    # the most bits in the window of each length from each integer on; zeros behind the end
    longest = int(COUNTS[1])
    widest = {1: np.r_[_bits(values), np.zeros(longest, np.uint8)]}
    selector = np.zeros(n, np.uint8)  # an escape, unless the integer fits a word
    selector[widest[1][:n] <= WIDTHS[15]] = 15
    for s, (length, shorter, shift) in zip(range(14, 0, -1), _WINDOWS):
        window = widest[shorter].copy()
        np.maximum(window[:-shift], widest[shorter][shift:], out=window[:-shift])
        widest[length] = window
        fits = window[:n] <= WIDTHS[s]
        if not fits.any():
            break  # nor does a longer window, whose integers get fewer bits
        np.copyto(selector, s, where=fits)
    starts = _orbit(np.minimum(np.arange(n) + COUNTS[selector], n))
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.r_[values, np.zeros(int(COUNTS[1]), np.uint64)]
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            lanes = np.arange(COUNTS[s])
            fields = padded[starts[mine][:, None] + lanes] << (lanes * WIDTHS[s]).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(fields, axis=1)
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, values[starts[escaped]]


def decode(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` integers of the words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[chosen])
    starts = ends - COUNTS[chosen]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            lanes = np.arange(COUNTS[s])
            fields = payload[mine][:, None] >> (lanes * WIDTHS[s]).astype(np.uint64)
            out[starts[mine][:, None] + lanes] = fields & np.uint64((1 << int(WIDTHS[s])) - 1)
    mine = np.flatnonzero(chosen == 0)
    out[starts[mine]] = escaped[payload[mine].astype(np.int64)]
    return out[:n]
