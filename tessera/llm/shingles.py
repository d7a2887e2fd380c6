"""Word shingles of whole texts, as 64-bit hashes, by NumPy passes over the bytes of a batch."""

from __future__ import annotations

import numpy as np

from .common import SEPARATORS, groups_of
from .pretokens import mix, powers

WIDTH = 5
#: Bytes that one pass takes; texts are cut at separators, so a pass never splits a word.
SLICE = 1 << 18
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SEPARATORS)] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each text's words). Words never cross texts."""
    begin, end = int(offsets[0]), int(offsets[-1])
    marks = np.zeros(end - begin + 1, bool)
    marks[offsets - begin] = True
    found, places = [], []
    at = begin
    while at < end:
        stop = min(at + SLICE, end)
        if stop < end:  # back to a separator, or on to the next one inside a giant word
            back = np.flatnonzero(_SEPARATOR[data[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                stop = next((stop + int(on[0]) for s in range(stop, end, SLICE) if len(on := np.flatnonzero(_SEPARATOR[data[s : s + SLICE]]) + (s - stop))), end)
        part = data[at:stop]
        inside = ~_SEPARATOR[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | marks[at - begin + 1 : stop - begin]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | marks[at - begin + 1 : stop - begin]
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        found.append(mix((sums[z] - sums[a]) * down[a]))
        places.append(a + at)
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.concatenate(places)
    return np.concatenate(found), np.searchsorted(where, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, bounds of each text's). A text of fewer words than ``width`` has one, of all its words."""
    w, bounds = words(data, offsets)
    n = np.diff(bounds)
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    found = np.zeros(int(out[-1]), np.uint64)
    if len(w) >= width:
        rolled = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            rolled *= _STEP
            rolled += w[k : len(w) - width + 1 + k]
        whole = np.flatnonzero(n >= width)
        if len(whole):
            take = np.arange(int(size[whole].sum())) + np.repeat(bounds[whole] - np.concatenate([[0], np.cumsum(size[whole])[:-1]]), size[whole])
            put = np.arange(len(take)) + np.repeat(out[whole] - np.concatenate([[0], np.cumsum(size[whole])[:-1]]), size[whole])
            found[put] = rolled[take]
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = np.uint64(n[i])
        for x in w[bounds[i] : bounds[i + 1]]:
            h = np.uint64((int(h) * int(_STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        found[out[i]] = h
    return mix(found), out


def batches(data: np.ndarray, offsets: np.ndarray, limit: int = 2 * SLICE):
    """(first text, end, shingles, bounds) for groups of texts of bounded size."""
    for a, b in groups_of(offsets, limit):
        found, bounds = shingles(data, offsets[a : b + 1])
        yield a, b, found, bounds
