"""Rolling hashes and content-defined anchors over concatenated sequences, in numpy.

A sequence is cut by `ends`, so that no gram and no window crosses from one document into the next. Anchors are window
minima of gram hashes: of all grams inside a window of `span` units the one with the smallest hash, the leftmost of
equals. The choice depends on the window's content alone, so equal windows have equal anchors at equal places.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE_BITS = 30
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of a common public 64-bit generator."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def byte_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8 - n % 8 if n % 8 else n, np.uint64)
    for shift in range(8):
        out[shift::8] = np.frombuffer(padded, "<u8", count=len(out[shift::8]), offset=shift)
    return out[:n]


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on (8 <= k), for places 0 to n - k."""
    n = len(data)
    if n < k:
        return np.empty(0, np.uint64)
    words, count = byte_words(data), n - k + 1
    h = np.zeros(count, np.uint64)
    for at in [*range(0, k - 8, 8), k - 8]:
        h = (h ^ words[at:at + count]) * _A
        h ^= h >> np.uint64(29)
    return h * _C


def word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each place on."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    count = n - k + 1
    h = np.zeros(count, np.uint64)
    for at in range(k):
        h = (h ^ hashes[at:at + count]) * _A
        h ^= h >> np.uint64(29)
    return h * _C


def window_starts(lengths: np.ndarray, span: int) -> np.ndarray:
    """Of each place of the concatenated documents: does a window of `span` units start here?"""
    total = int(lengths.sum())
    open_ = np.zeros(total + 1, np.int64)
    ends = np.cumsum(lengths)
    long = lengths >= span
    np.add.at(open_, (ends - lengths)[long], 1)
    np.add.at(open_, (ends - span + 1)[long], -1)
    return np.cumsum(open_[:-1]) > 0


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """For each place the smallest of `width` grams: upper bits of its hash, its place in the lower bits."""
    if len(grams) >= 1 << _PLACE_BITS:
        raise ValueError("cut the batch: more units than places")
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return low


def anchor_runs(grams: np.ndarray, lengths: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one document with the same anchor: first window, last window, anchor place."""
    width = span - k + 1
    empty = np.empty(0, np.int64)
    if len(grams) < width:
        return empty, empty, empty
    low = _window_minima(grams, width)
    at = np.flatnonzero(window_starts(lengths, span)[:len(low)])
    if not len(at):
        return empty, empty, empty
    place = (low[at] & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - span + 1, 0))
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], place[first]


# words of UTF-8 texts -------------------------------------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * _A)
_BASE, _INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; `ends` are the ends of the documents."""
    solid = ~_BLANK[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = ends[ends < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[ends[ends > 0] - 1] = False
    return starts, np.flatnonzero(solid & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from a running polynomial sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=total[1:])
    back = _powers(_INVERSE, len(data))
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _C)
