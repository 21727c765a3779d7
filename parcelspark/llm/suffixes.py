"""Suffix order by hash comparison: common extensions by binary search over prefix polynomial hashes."""

from __future__ import annotations

import numpy as np

STEPS = tuple(1 << k for k in range(12, -1, -1))  # longest extension looked for: 8191


class Extensions:
    """Longest common extensions between places of one text, many pairs at a time."""

    def __init__(self, data: np.ndarray, base_powers: tuple[np.ndarray, np.ndarray]):
        up, self.down = base_powers
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most ``limit``."""
        out = np.zeros(len(a), np.int64)
        top = int(limit.max(initial=0))
        for step in STEPS:
            if step > top:
                continue
            at = out + step
            can = np.flatnonzero(at <= limit)
            if not len(can):
                continue
            x, y, n = a[can], b[can], step
            x, y = x + out[can], y + out[can]
            same = (self.sums[x + n] - self.sums[x]) * self.down[x] == (self.sums[y + n] - self.sums[y]) * self.down[y]
            out[can[same]] += step
        return out


def merge_sorted(ext: Extensions, start: np.ndarray, length: np.ndarray, group_start: np.ndarray, group_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes (start, length) within each group: (order, common prefix with the one before in the group).

    A bottom-up mergesort of all groups together: in a round every suffix finds its rank in
    the run it is merged with by binary search, and each comparison is a common-prefix search
    followed by one byte. ``group_start`` and ``group_size`` are given for each suffix.
    """
    n = len(start)
    order = np.arange(n)

    def less(a, b):
        """-1, 0 or 1 as suffix a sorts before, with or after suffix b."""
        limit = np.minimum(length[a], length[b])
        c = ext.common(start[a], start[b], limit)
        x = np.where(c < length[a], ext.data[np.minimum(start[a] + c, len(ext.data) - 1)].astype(np.int64), -1)
        y = np.where(c < length[b], ext.data[np.minimum(start[b] + c, len(ext.data) - 1)].astype(np.int64), -1)
        return (x > y).astype(np.int8) - (x < y)  # a difference of numbered tokens could overflow

    width, largest = 1, int(group_size.max(initial=0))
    slot = np.arange(n)
    while width < largest:
        live = np.flatnonzero(group_size > width)  # slots of groups that still have runs to merge
        inside = slot[live] - group_start[live]
        run = inside // width
        left_run = run % 2 == 0
        end = group_start[live] + group_size[live]
        own_start = group_start[live] + run * width
        other_start = np.minimum(np.where(left_run, own_start + width, own_start - width), end)
        other_end = np.minimum(other_start + width, end)
        lo, hi = other_start.copy(), other_end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            sign = less(order[live[open_]], order[mid])
            # equal suffixes of the left run stay in front
            right = np.where(left_run[open_], sign > 0, sign >= 0)
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        place = np.minimum(own_start, np.where(left_run, own_start, other_start)) + (slot[live] - own_start) + (lo - other_start)
        fresh = order.copy()
        fresh[place] = order[live]
        order = fresh
        width *= 2
    before = np.r_[0, order[:-1]] if n else order
    common = ext.common(start[order], start[before], np.minimum(length[order], length[before]))
    common[slot == group_start] = 0
    return order, common


def covered_lengths(
    data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, groups: np.ndarray, size: int, base_powers,
    owner: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor (least, most, partner): the window of ``size`` units that begins l units before it occurs at another anchor of its group, for both l.

    ``data`` holds bytes or numbered tokens; anchors have ``left`` and ``right`` units of context. Two anchors with a common left
    extension L and right extension R share the windows for l from size - R to L. Anchors are
    sorted by their right context and by their reversed left context; each looks at its
    neighbours in the left order, then outwards in the right order, as long as the running
    common prefix and its own best left extension still make up ``size``. -1 where there is none; the partner shares the window of the largest l.
    With ``owner``, anchors of an equal owner are no partners (the extensions to them only bound the search).
    """
    n = len(anchor)
    first = np.r_[True, groups[1:] != groups[:-1]] if n else np.empty(0, bool)
    at = np.flatnonzero(first)
    sizes = np.diff(np.r_[at, n])
    group_start, group_size = np.repeat(at, sizes), np.repeat(sizes, sizes)
    ahead = Extensions(data, base_powers)
    back = Extensions(data[::-1].copy(), base_powers)
    mirrored = len(data) - anchor
    right_order, right_common = merge_sorted(ahead, anchor, right, group_start, group_size)
    left_order, left_common = merge_sorted(back, mirrored, left, group_start, group_size)
    slot = np.arange(n)
    right_slot, left_slot = np.empty(n, np.int64), np.empty(n, np.int64)
    right_slot[right_order], left_slot[left_order] = slot, slot
    group_end = group_start + group_size
    padded_left, padded_right = np.r_[left_common, 0], np.r_[right_common, 0]
    padded_left[group_end - 1 + 1] = 0  # the first of each group has nothing in common with what is before it
    best_left = np.maximum(padded_left[left_slot], padded_left[left_slot + 1])
    least, most = np.full(n, size + 1), np.full(n, -1)
    least_with, most_with = np.full(n, -1), np.full(n, -1)

    def probe(i, j, r):
        ext_left = back.common(mirrored[i], mirrored[j], np.minimum(left[i], left[j]))
        ok = ext_left + r >= size
        if owner is not None:
            ok &= owner[i] != owner[j]
        low, high = np.maximum(size - r, 0), ext_left
        better = ok & (low < least[i])
        least[i[better]], least_with[i[better]] = low[better], j[better]
        better = ok & (high > most[i])
        most[i[better]], most_with[i[better]] = high[better], j[better]
        return ok

    for side in (-1, 1):
        near = left_slot + side
        i = np.flatnonzero((near >= group_start) & (near < group_end))
        j = left_order[near[i]]
        probe(i, j, ahead.common(anchor[i], anchor[j], np.minimum(right[i], right[j])))
    for side in (-1, 1):
        i, at, running = np.arange(n), right_slot.copy(), np.full(n, np.iinfo(np.int64).max)
        while len(i):
            step = at + side
            inside = (step >= group_start[i]) & (step < group_end[i])
            i, at, step, running = i[inside], at[inside], step[inside], running[inside]
            running = np.minimum(running, padded_right[np.maximum(at, step)])
            can = running + best_left[i] >= size
            i, at, running = i[can], step[can], running[can]
            if not len(i):
                break
            hit = probe(i, right_order[at], running)
            go_on = ~(hit & (most[i] >= best_left[i]))
            i, at, running = i[go_on], at[go_on], running[go_on]
    least[most < 0] = -1
    # hashes said so; the text itself decides
    raw, wide = data.tobytes(), data.itemsize

    def window(i, before):
        at = (anchor[i] - before) * wide
        return raw[at:at + size * wide]

    for i in np.flatnonzero(most >= 0).tolist():
        if any(window(i, w) != window(j, w) for w, j in ((most[i], most_with[i]), (least[i], least_with[i]))):
            least[i], most[i], most_with[i] = _without_hashes(window, i, left, right, _others(i, int(group_start[i]), int(group_end[i]), owner), size)
    return least, most, most_with


def _others(i: int, start: int, end: int, owner) -> list[int]:
    return [j for j in range(start, end) if owner is None or owner[j] != owner[i]]


def _without_hashes(window, i: int, left, right, members, size: int) -> tuple[int, int, int]:
    """The same for one anchor without hashes, for the rare case of a collision."""
    found = [
        (w, j) for w in range(size + 1) if w <= left[i] and size - w <= right[i] for j in members
        if j != i and w <= left[j] and size - w <= right[j] and window(i, w) == window(j, w)]
    return (found[0][0], *found[-1]) if found else (-1, -1, -1)
