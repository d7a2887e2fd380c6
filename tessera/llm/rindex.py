"""Long matches among aligned contexts by a run-length compressed Burrows-Wheeler transform.

A context is what lies around an anchor: ``left`` is read leftwards from the anchor's end, ``right`` rightwards from
there on.  Contexts of one group share their anchor, and only matches across the anchor are asked for, so every
symbol is tagged with its distance from the anchor.  The transform of the tagged contexts falls into columns (the
positional form of the transform): column c has the symbols before the suffixes that begin c symbols left of the
anchor's end, in the order of those suffixes.  A step to the next column (LF) is a stable sort by the column's
symbols, so no suffix array is needed.

Each column is kept as runs of equal symbols.  Two suffixes that are neighbours inside a run stay neighbours, and
what they share grows by one symbol: nothing is computed for them.  Only at run ends new neighbours meet; what they
share is sampled there, as the least value between their ranks among the right sides.  So the matching statistics
are streamed over the columns, from the anchor to the left.  A context that occurs ``weight`` times stands for as
many rows, a run by itself: its rows share everything, and it isn't written out twice.

Suffixes that no other suffix of their group equals as far as the anchor leave the index, as they have no match.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    """``left`` (m, width) and ``right`` (m, reach) hold symbols from 1 on, 0 beyond the text's ends; ``group`` ascends."""

    def __init__(self, group: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> None:
        m, self.reach = right.shape
        kind = ">u2" if right.dtype.itemsize <= 2 else ">u4"
        raw = np.concatenate([group.astype(">u4")[:, None].view(np.uint8), np.ascontiguousarray(right.astype(kind)).view(np.uint8).reshape(m, -1)], axis=1)
        raw = np.ascontiguousarray(raw)
        self.order = np.argsort(raw.view(np.dtype((np.void, raw.shape[1]))).ravel(), kind="stable")
        ranked, self.group = right[self.order], group[self.order]
        apart = ranked[1:] != ranked[:-1]
        shared = np.where(apart.any(axis=1), apart.argmax(axis=1), self.reach) if self.reach else np.zeros(max(m - 1, 0), np.int64)
        shared[self.group[1:] != self.group[:-1]] = -1
        #: What the right sides of ranks k - 1 and k share; -1 where a group begins.
        self.shared = np.concatenate([[-1], shared]).astype(np.int32)
        self.columns = np.ascontiguousarray(left[self.order].T)
        self.weight = weight[self.order]
        self.room = (ranked != 0).sum(axis=1)
        self._least = [self.shared]
        while 2 << (len(self._least) - 1) <= m:
            below, step = self._least[-1], 1 << (len(self._least) - 1)
            self._least.append(np.minimum(below[:-step], below[step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the right sides of ranks a < b share."""
        out = np.empty(len(a), np.int32)
        level = np.frexp((b - a).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self._least[k][a[at] + 1], self._least[k][b[at] - (1 << k) + 1])
        return out

    def statistics(self):
        """For each number of left symbols from 0 on: (ranks, the right symbols that the longest match elsewhere has)."""
        live = np.arange(len(self.group))
        head = self.shared < 0
        near = self.shared
        base = int(self.columns.max(initial=0)) + 1
        best = self._best(live, near)
        yield live, best
        for column in self.columns:
            symbol = column[live]
            if not ((symbol[1:] == symbol[:-1]) | head[1:]).all() or not symbol.all():  # else a run for each class
                order = np.argsort(np.cumsum(head, dtype=np.int64) * base + symbol, kind="stable")  # LF
                key = (np.cumsum(head, dtype=np.int64) * base + symbol)[order]
                head = np.concatenate([[True], key[1:] != key[:-1]])
                inside = np.concatenate([[False], order[1:] == order[:-1] + 1])
                live, near = live[order], near[order]
                met = np.flatnonzero(~inside & ~head)  # at the ends of runs
                near[met] = self.between(live[met - 1], live[met])
                near[head] = -1
                alone = head & np.append(head[1:], True) & (self.weight[live] == 1)
                keep = ~alone & (symbol[order] != 0)
                live, near, head = live[keep], near[keep], head[keep]
                best = self._best(live, near)
            yield live, best
            if not len(live):
                return

    def _best(self, live: np.ndarray, near: np.ndarray) -> np.ndarray:
        best = np.maximum(near, np.append(near[1:], -1))
        best[self.weight[live] > 1] = self.reach
        return np.minimum(best, self.room[live])

    def matches(self, length: int) -> np.ndarray:
        """(m, reach + 1): whether the string of ``length`` symbols that begins k - reach symbols from the anchor occurs elsewhere in the group."""
        anchor = length - self.reach
        found = np.zeros((self.reach + 1, len(self.group)), bool)
        for taken, (live, best) in enumerate(self.statistics()):
            if anchor <= taken <= length:
                found[length - taken, live] = best >= length - taken
        out = np.empty((len(self.group), self.reach + 1), bool)
        out[self.order] = found.T
        return out
