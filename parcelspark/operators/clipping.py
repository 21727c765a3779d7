"""Polygons cut to a box, exactly: a concave polygon falls into as many parts as the box leaves of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import RingRows, parts_array
from .shapes import RINGS

PARTS = T.ArrayType(RINGS)


def _twice_area(p: np.ndarray) -> float:
    q = p - p[0]
    after = np.roll(q, -1, axis=0)
    return float((q[:, 0] * after[:, 1] - after[:, 0] * q[:, 1]).sum())


def _half_plane(loops: list[np.ndarray], axis: int, limit: float, keep_low: bool) -> list[np.ndarray]:
    """Loops (exteriors counter-clockwise, holes clockwise) cut along one line.

    What lies inside of a loop is a set of chains, each from where it enters to where it leaves. Along the
    line the polygon covers intervals whose ends are in turn an entry and an exit, so the k-th entry and the
    k-th exit belong together, whatever loops they come from: a chain goes on with the entry of its exit.
    Positions on the line count as outside, so every crossing has a definite side.
    """
    kept, chains = [], []
    for p in loops:
        d = limit - p[:, axis] if keep_low else p[:, axis] - limit
        inside = d > 0
        if inside.all():
            kept.append(p)
        elif inside.any():
            n = len(p)
            enters = np.flatnonzero(inside & ~np.roll(inside, 1))
            leaves = np.flatnonzero(inside & ~np.roll(inside, -1))
            leaves = np.roll(leaves, -int(np.searchsorted(leaves, enters[0])))

            def cut(a: int, b: int) -> np.ndarray:
                at = p[a] + d[a] / (d[a] - d[b]) * (p[b] - p[a])
                at[axis] = limit
                return at

            for first, last in zip(enters, leaves, strict=True):
                middle = np.arange(first, last + 1 if last >= first else last + 1 + n) % n
                chains.append(np.vstack([cut(first - 1, first), p[middle], cut(last, (last + 1) % n)]))
    if not chains:
        return kept
    other = 1 - axis
    entry_order = np.argsort([c[0, other] for c in chains], kind="stable")
    exit_order = np.argsort([c[-1, other] for c in chains], kind="stable")
    follows = np.empty(len(chains), int)
    follows[exit_order] = entry_order
    open_ = np.ones(len(chains), bool)
    for start in range(len(chains)):
        walk, at = [], start
        while open_[at]:
            open_[at] = False
            walk.append(chains[at])
            at = follows[at]
        if walk:
            kept.append(np.vstack(walk))
    return kept


def _tidy(p: np.ndarray) -> np.ndarray:
    """Without positions that repeat the one before."""
    return p[(p != np.roll(p, 1, axis=0)).any(axis=1)]


def _holds(shell: np.ndarray, point: np.ndarray) -> bool:
    a, b = shell, np.roll(shell, -1, axis=0)
    over = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    a, b = a[over], b[over]
    return bool(np.count_nonzero(point[0] < (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]) & 1)


def clip_to_box(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> list[list[np.ndarray]]:
    """Parts of a valid polygon inside a box, from left to right; each part is its exterior and its holes."""
    loops = []
    for k, ring in enumerate(rings):
        p = _tidy(ring[:-1])
        if len(p) >= 3:
            loops.append(p if (_twice_area(p) > 0) == (k == 0) else p[::-1])
    scale = 0.0
    for axis, limit, low in ((0, box[0], False), (0, box[2], True), (1, box[1], False), (1, box[3], True)):
        loops = _half_plane(loops, axis, limit, low)
        scale = max(scale, abs(limit))
    sized = [(p, _twice_area(p)) for p in map(_tidy, loops) if len(p) >= 3]
    noise = 1e-12 * max(1.0, scale)  # a strip as thin as the rounding of its coordinates
    sized = [(p, a) for p, a in sized if abs(a) > noise]
    parts = sorted(([p] for p, a in sized if a > 0), key=lambda part: tuple(part[0].min(axis=0)))
    for hole in (p for p, a in sized if a < 0):
        around = [part for part in parts if _holds(part[0], hole[0])]
        if around:
            min(around, key=lambda part: _twice_area(part[0])).append(hole)
    return [[np.vstack([r, r[:1]]) for r in part] for part in parts]


@F.arrow_udf(PARTS)
def clip_parts(rings: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    """Parts of a polygon inside a box; null when nothing with an area is left, or without a geometry."""
    rows = RingRows(rings)
    boxes = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (minx, miny, maxx, maxy)], axis=1)
    out = []
    for i in range(len(rows)):
        polygon = rows.polygon(i)
        usable = polygon and np.isfinite(boxes[i]).all() and all(np.isfinite(r).all() for r in polygon)
        out.append((usable and clip_to_box(polygon, tuple(boxes[i]))) or None)
    return parts_array(out)
