"""Windows of shingles around one anchor that are similar to the same window around another anchor."""

from __future__ import annotations

import numpy as np

from .common import mixed

SHIFT = 3  # words that may come in or drop out inside a passage before its two sides are compared apart
MEETINGS = 1 << 20  # meetings of shingles in memory


class Similar:
    """Which windows around one anchor are similar to the same window around another anchor of its group.

    A shingle of the window counts as shared if the other anchor has it within ``SHIFT`` places of
    the same distance. Shared s of ``size`` give a Jaccard similarity of s / (2 size - s).
    """

    def __init__(self, data, anchor, left, right, size: int, similarity: float):
        self.size, self.span = size, 2 * size - 1
        self.need = int(np.ceil(2 * size * similarity / (1 + similarity) - 1e-9))
        places = np.arange(-size + 1, size)
        self.inside = (places >= -left[:, None]) & (places < right[:, None])
        self.grid = np.where(self.inside, data[np.clip(anchor[:, None] + places, 0, len(data) - 1)], 0)
        self.before = size - 1 - np.arange(size)  # window w begins size - 1 - w places before the anchor
        self.whole = (self.before <= left[:, None]) & (size - self.before <= right[:, None])
        # the windows of each anchor that begin first and last; -1 without any
        some = self.whole.any(axis=1)
        self.lowest = np.where(some, self.before[size - 1 - self.whole[:, ::-1].argmax(axis=1)], -1)
        self.highest = np.where(some, self.before[self.whole.argmax(axis=1)], -1)

    def hits(self, a, b):
        """(a, b, least, most) of the pairs with a similar window of a."""
        size, span, grid = self.size, self.span, self.grid
        shared = np.zeros((len(a), span), bool)
        for shift in range(-SHIFT, SHIFT + 1):
            lo, hi = max(0, -shift), span - max(0, shift)
            shared[:, lo:hi] |= grid[a, lo:hi] == grid[b, lo + shift:hi + shift]
        shared &= grid[a] != 0
        counts = np.zeros((len(a), span + 1), np.int32)
        np.cumsum(shared, axis=1, out=counts[:, 1:])
        within = counts[:, size:] - counts[:, :size]
        ok = (within >= self.need) & self.whole[a]
        hit = ok.any(axis=1)
        ok = ok[hit]
        return a[hit], b[hit], self.before[size - 1 - ok[:, ::-1].argmax(axis=1)], self.before[ok.argmax(axis=1)]

    def _common(self, rows, groups):
        """(rows that can take part, numbers of their shingles in the group, places of each number): at some window enough shingles are met twice in the group."""
        size = self.size
        while True:
            inside = self.inside[rows]
            cells = self.grid[rows][inside] + mixed(np.repeat(groups[rows].astype(np.uint64), inside.sum(axis=1)))
            _, number, count = np.unique(cells, return_inverse=True, return_counts=True)
            met = np.zeros(inside.shape, np.int32)
            met[inside] = count[number] > 1
            sums = np.cumsum(np.pad(met, ((0, 0), (SHIFT + 1, SHIFT))), axis=1)
            width = size + 2 * SHIFT
            kept = ((sums[:, width:] - sums[:, :-width]) >= self.need).any(axis=1)
            if kept.all():
                return rows, inside, number, count
            rows = rows[kept]

    def first_ones(self, rank, width, usable):
        """Places whose rank is among the first of some usable window of ``width`` places around."""
        windows = np.lib.stride_tricks.sliding_window_view(rank, width, axis=1)
        bound = np.where(usable, np.partition(windows, width - self.need, axis=2)[:, :, width - self.need], -1)
        padded = np.pad(bound, ((0, 0), (width - 1, width - 1)), constant_values=-1)
        covered = 1
        while covered < width:  # running maximum of the windows that cover a place
            step = min(covered, width - covered)
            padded = np.maximum(padded[:, :-step], padded[:, step:])
            covered += step
        return rank <= padded

    def candidates(self, rows, groups, open_windows, minor):
        """(a, b), in parts, of pairs of ``rows`` of a group in which a window of a can be similar at b: all windows if a or b is ``minor``, else the open ones.

        With the shingles of a group in one order, rare ones first, the first shared one is among the
        size - need + 1 first of the window, and of the window and ``SHIFT`` places on either side of it at b.
        So the pairs that share such a shingle at about the same distance lose no window that shares its
        shingles with as many places of b.
        """
        size = self.size
        rows, inside, number, count = self._common(rows, groups)
        if not len(rows):
            return
        groups, whole, minor = groups[rows], self.whole[rows], minor[rows, None]
        place_of = np.empty(len(count), np.int64)
        place_of[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))
        rank = np.full(inside.shape, len(count), np.int32)
        rank[inside] = place_of[number]
        alone = np.zeros(len(count) + 1, bool)
        alone[place_of] = count == 1

        wide = np.pad(rank, ((0, 0), (SHIFT, SHIFT)), constant_values=len(count))
        known = inside & ~alone[rank]
        given = self.first_ones(wide, size + 2 * SHIFT, True)[:, SHIFT:wide.shape[1] - SHIFT] & known
        every = self.first_ones(rank, size, whole) & known
        some = self.first_ones(rank, size, whole & (open_windows[rows] | minor)) & known
        for asked, given in ((some, given), (every & ~minor, given & minor)):
            asked, given = np.nonzero(asked), np.nonzero(given)
            order = np.argsort(rank[given], kind="stable")
            row, place = given[0][order], given[1][order]
            kind, wanted = rank[row, place], rank[asked]
            first, last = np.searchsorted(kind, wanted, "left"), np.searchsorted(kind, wanted, "right")
            made = np.cumsum(last - first)
            i = 0
            while i < len(wanted):
                j = max(i + 1, int(np.searchsorted(made, (made[i - 1] if i else 0) + MEETINGS, "right")))
                n = last[i:j] - first[i:j]
                at = np.arange(int(n.sum())) + np.repeat(first[i:j] - (np.cumsum(n) - n), n)
                a, b = np.repeat(asked[0][i:j], n), row[at]
                near = (np.abs(np.repeat(asked[1][i:j], n) - place[at]) <= SHIFT) & (a != b) & (groups[a] == groups[b])
                yield rows[a[near]], rows[b[near]]
                i = j
