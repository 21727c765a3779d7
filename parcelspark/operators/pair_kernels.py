"""Arrow kernels over pairs of polygons: shared area, least distance, mean boundary distance; and edges of one that conflict.

A batch of pairs is worked on as flat edge buffers. Which edges of the two polygons meet is a range per edge:
all edges of the other polygon, or for polygons of many edges those whose x-range can matter (edges sorted by
their left end, with the running maximum of the right ends). So neither the batch nor a pair is ever
edges x edges in memory, and long boundaries are not compared edge by edge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

AT_ONCE = 1 << 19  # edge pairs in memory
INDEXED = 4096  # edge pairs of a row from which on ranges are looked up


class Polygons:
    """Ring columns as flat arrays: edges of all rings, with the first edge of each row and the ring of each edge."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        rings = column.flatten()  # leaves out null polygons
        points = rings.flatten()
        x, y = (points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
        n_points = np.where(rings.is_valid().to_numpy(zero_copy_only=False), np.diff(rings.offsets.to_numpy()), 0)
        n_rings = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
        point_at = np.concatenate([[0], np.cumsum(n_points)])
        ring_at = np.concatenate([[0], np.cumsum(n_rings)])
        is_edge = np.ones(max(len(x) - 1, 0), bool)
        is_edge[point_at[1:-1][(point_at[1:-1] > 0) & (point_at[1:-1] < len(x))] - 1] = False
        self.x1, self.y1, self.x2, self.y2 = x[:-1][is_edge], y[:-1][is_edge], x[1:][is_edge], y[1:][is_edge]
        edges = np.maximum(n_points - 1, 0)
        self.ring_edges = np.concatenate([[0], np.cumsum(edges)])
        self.at = self.ring_edges[ring_at]  # first edge of each row, and the end
        self.ring_at = ring_at
        self.n = len(column)

    def exterior(self, i: int) -> slice:
        r = self.ring_at[i]
        return slice(self.ring_edges[r], self.ring_edges[r + 1]) if self.ring_at[i + 1] > r else slice(0, 0)

    def turns(self, x0: np.ndarray, y0: np.ndarray) -> np.ndarray:
        """+1 or -1 per edge: by it an exterior runs counter-clockwise and a hole clockwise."""
        rings = len(self.ring_edges) - 1
        ring = np.repeat(np.arange(rings), np.diff(self.ring_edges))
        first = self.ring_edges[:-1][ring]
        ox, oy = self.x1[first], self.y1[first]
        area = np.bincount(
            ring, weights=(self.x1 - ox) * (self.y2 - oy) - (self.x2 - ox) * (self.y1 - oy), minlength=rings)
        is_hole = np.ones(rings, bool)
        is_hole[self.ring_at[:-1][np.diff(self.ring_at) > 0]] = False
        return np.where(area >= 0, 1.0, -1.0)[ring] * np.where(is_hole, -1.0, 1.0)[ring]


def meetings(first: np.ndarray, last: np.ndarray):
    """(left item, right item) in parts of about AT_ONCE: item i meets all of first[i] .. last[i]-1."""
    n = last - first
    made = np.cumsum(n)
    i = 0
    while i < len(n):
        before = made[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(made, before + AT_ONCE, "right")))
        m = n[i:j]
        offset = np.cumsum(m) - m
        yield np.repeat(np.arange(i, j), m), np.arange(int(m.sum())) + np.repeat(first[i:j] - offset, m)
        i = j


def x_ranges(left_from: np.ndarray, left_to: np.ndarray, right_from: np.ndarray, running: np.ndarray):
    """Range of the right intervals (sorted by start, with the running maximum of their ends) that can touch each left one."""
    return np.searchsorted(running, left_from, "left"), np.searchsorted(right_from, left_to, "right")


def _lower_borders(p: Polygons, ox: np.ndarray, oy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(xl, xr, yl, slope, sign) of the non-vertical edges sorted by row and left end, and the first of each row."""
    row = np.repeat(np.arange(p.n), np.diff(p.at))
    sign = p.turns(ox, oy) * np.where(p.x1 > p.x2, 1.0, -1.0)
    keep = np.flatnonzero(p.x1 != p.x2)
    xl = np.minimum(p.x1, p.x2)[keep] - ox[row[keep]]
    keep, xl = (v[np.lexsort((xl, row[keep]))] for v in (keep, xl))
    row = row[keep]
    x1, y1, x2, y2 = p.x1[keep], p.y1[keep], p.x2[keep], p.y2[keep]
    yl = np.where(x1 < x2, y1, y2) - oy[row]
    edges = np.stack([xl, np.maximum(x1, x2) - ox[row], yl, (y2 - y1) / (x2 - x1), sign[keep]])
    return edges, np.searchsorted(row, np.arange(p.n + 1))


def shared_areas(a: Polygons, b: Polygons) -> np.ndarray:
    """Overlap area of each pair: the sum over edge pairs of the signed area under the lower of two edges."""
    ox, oy = np.zeros(a.n), np.zeros(a.n)
    has = np.flatnonzero(np.diff(a.at) > 0)
    ox[has], oy[has] = a.x1[a.at[has]], a.y1[a.at[has]]
    e, e_at = _lower_borders(a, ox, oy)
    g, g_at = _lower_borders(b, ox, oy)
    row = np.repeat(np.arange(a.n), np.diff(e_at))
    first, last = g_at[row].copy(), g_at[row + 1].copy()
    for i in np.flatnonzero(np.diff(e_at) * np.diff(g_at) > INDEXED):
        mine, other = slice(e_at[i], e_at[i + 1]), slice(g_at[i], g_at[i + 1])
        lo, hi = x_ranges(e[0, mine], e[1, mine], g[0, other], np.maximum.accumulate(g[1, other]))
        first[mine], last[mine] = g_at[i] + lo, g_at[i] + np.maximum(lo, hi)
    total = np.zeros(a.n)
    for i, j in meetings(first, last):
        exl, exr, eyl, em, es = e[:, i]
        gxl, gxr, gyl, gm, gs = g[:, j]
        left, right = np.maximum(exl, gxl), np.minimum(exr, gxr)
        meet = left < right
        i, left, right, exl, eyl, em, es, gxl, gyl, gm, gs = (
            v[meet] for v in (i, left, right, exl, eyl, em, es, gxl, gyl, gm, gs))
        fl, fr = eyl + em * (left - exl), eyl + em * (right - exl)
        dl, dr = fl - (gyl + gm * (left - gxl)), fr - (gyl + gm * (right - gxl))
        with np.errstate(divide="ignore", invalid="ignore"):
            above = np.where(
                (dl >= 0) & (dr >= 0), (dl + dr) / 2,
                np.where((dl <= 0) & (dr <= 0), 0.0, np.where(dl > 0, dl * dl / (2 * (dl - dr)), dr * dr / (2 * (dr - dl)))))
        total += np.bincount(row[i], weights=es * gs * (right - left) * ((fl + fr) / 2 - above), minlength=a.n)
    return np.fmax(total, 0.0)


def _point_gaps(px, py, x1, y1, x2, y2) -> np.ndarray:
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(square > 0, ((px - x1) * dx + (py - y1) * dy) / square, 0.0)
    t = np.clip(t, 0.0, 1.0)
    return np.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def _samples(p: Polygons, i: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` points at fractions 0, 1/count, ... of the exterior."""
    part = p.exterior(i)
    x1, y1, x2, y2 = (v[part] for v in (p.x1, p.y1, p.x2, p.y2))
    moved = (x1 != x2) | (y1 != y2)
    x1, y1, x2, y2 = x1[moved], y1[moved], x2[moved], y2[moved]
    if not len(x1):
        return np.empty(0), np.empty(0)
    to = np.cumsum(np.hypot(x2 - x1, y2 - y1))
    start = np.concatenate([[0.0], to[:-1]])
    at = np.arange(count) * (to[-1] / count)
    k = np.minimum(np.searchsorted(to, at, "right"), len(to) - 1)
    along = (at - start[k]) / (to[k] - start[k])
    return x1[k] + along * (x2[k] - x1[k]), y1[k] + along * (y2[k] - y1[k])


def _directed_means(a: Polygons, b: Polygons, count: int) -> np.ndarray:
    """Mean over samples of a's exterior of the distance to the nearest edge of b; nan without either."""
    points = [_samples(a, i, count) for i in range(a.n)]
    n = np.array([len(x) for x, _ in points])
    px, py = (np.concatenate([p[k] for p in points]) if a.n else np.empty(0) for k in (0, 1))
    row = np.repeat(np.arange(a.n), n)
    first, last = b.at[row], b.at[row + 1]
    least = np.full(len(px), np.inf)
    for i, j in meetings(first, last):
        gaps = _point_gaps(px[i], py[i], b.x1[j], b.y1[j], b.x2[j], b.y2[j])
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        if len(starts):
            least[i[starts]] = np.minimum.reduceat(gaps, starts)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(row, weights=least, minlength=a.n) / n
    return np.where(np.isfinite(mean), mean, np.nan)


def _inside(px: float, py: float, p: Polygons, part: slice) -> bool:
    """Even-odd rule over all rings."""
    x1, y1, x2, y2 = p.x1[part], p.y1[part], p.x2[part], p.y2[part]
    over = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool(np.count_nonzero(over & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)) & 1)


def _gap(a: Polygons, b: Polygons, i: int) -> float:
    mine, other = slice(a.at[i], a.at[i + 1]), slice(b.at[i], b.at[i + 1])
    e = np.stack([v[mine] for v in (a.x1, a.y1, a.x2, a.y2)])
    g = np.stack([v[other] for v in (b.x1, b.y1, b.x2, b.y2)])
    if not e.shape[1] or not g.shape[1]:
        return np.nan
    if _inside(e[0, 0], e[1, 0], b, other) or _inside(g[0, 0], g[1, 0], a, mine):
        return 0.0
    # a first bound from some edges, so that most pairs are too far apart to be looked at
    some_e, some_g = (v[:, ::max(1, int(v.shape[1] ** 0.5))] for v in (e, g))
    bound = min(
        float(_point_gaps(p[0, :, None], p[1, :, None], *q[:, None, :]).min()) for p, q in ((some_e, some_g), (some_g, some_e)))
    g = g[:, np.argsort(np.minimum(g[0], g[2]), kind="stable")]
    g_from, running = np.minimum(g[0], g[2]), np.maximum.accumulate(np.maximum(g[0], g[2]))
    reach = bound * (1 + 1e-9)
    first, last = x_ranges(np.minimum(e[0], e[2]) - reach, np.maximum(e[0], e[2]) + reach, g_from, running)
    for k, j in meetings(first, np.maximum(first, last)):
        x1, y1, x2, y2 = e[:, k]
        u1, v1, u2, v2 = g[:, j]
        near = (np.minimum(v1, v2) <= np.maximum(y1, y2) + reach) & (np.maximum(v1, v2) >= np.minimum(y1, y2) - reach)
        x1, y1, x2, y2, u1, v1, u2, v2 = (v[near] for v in (x1, y1, x2, y2, u1, v1, u2, v2))
        if not len(x1):
            continue

        def side(ax, ay, bx, by, px, py):
            return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

        crossing = (side(x1, y1, x2, y2, u1, v1) * side(x1, y1, x2, y2, u2, v2) < 0) & (
            side(u1, v1, u2, v2, x1, y1) * side(u1, v1, u2, v2, x2, y2) < 0)
        if crossing.any():
            return 0.0
        bound = min(bound, *(float(d.min()) for d in (
            _point_gaps(x1, y1, u1, v1, u2, v2), _point_gaps(x2, y2, u1, v1, u2, v2),
            _point_gaps(u1, v1, x1, y1, x2, y2), _point_gaps(u2, v2, x1, y1, x2, y2))))
    return bound


def conflicts(p: Polygons) -> np.ndarray:
    """Whether two edges of a polygon cross, run along each other, or touch within a ring away from neighbours."""
    row = np.repeat(np.arange(p.n), np.diff(p.at))
    ring = np.repeat(np.arange(len(p.ring_edges) - 1), np.diff(p.ring_edges))
    keep = np.flatnonzero((p.x1 != p.x2) | (p.y1 != p.y2))
    row, ring = row[keep], ring[keep]
    x1, y1, x2, y2 = (v[keep] for v in (p.x1, p.y1, p.x2, p.y2))
    ring_at = np.searchsorted(ring, np.arange(len(p.ring_edges)))
    place, size = np.arange(len(ring)) - ring_at[ring], np.diff(ring_at)[ring]
    xl, xr, yl, yr = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    at = np.searchsorted(row, np.arange(p.n + 1))
    # each edge meets those after it; with very many edges, those whose x-range it can reach, whatever their order
    order = np.arange(len(row))
    first, last = order + 1, at[row + 1].copy()
    for i in np.flatnonzero(np.diff(at) ** 2 > INDEXED):
        part = slice(at[i], at[i + 1])
        order[part] = at[i] + np.argsort(xl[part], kind="stable")
        by_start = order[part]
        lo, hi = x_ranges(xl[part], xr[part], xl[by_start], np.maximum.accumulate(xr[by_start]))
        first[part], last[part] = at[i] + lo, at[i] + np.maximum(lo, hi)
    out = np.zeros(p.n, bool)

    def side(e, x, y):
        return (x2[e] - x1[e]) * (y - y1[e]) - (y2[e] - y1[e]) * (x - x1[e])

    for e, k in meetings(first, last):
        g = order[k]
        meet = (g > e) & (xl[g] <= xr[e]) & (xr[g] >= xl[e]) & (yl[g] <= yr[e]) & (yr[g] >= yl[e])
        e, g = e[meet], g[meet]
        d1, d2, d3, d4 = side(g, x1[e], y1[e]), side(g, x2[e], y2[e]), side(e, x1[g], y1[g]), side(e, x2[g], y2[g])
        common_x = np.minimum(xr[e], xr[g]) - np.maximum(xl[e], xl[g])
        common_y = np.minimum(yr[e], yr[g]) - np.maximum(yl[e], yl[g])
        along = (d1 == 0) & (d2 == 0) & ((common_x > 0) | (common_y > 0))
        gap = place[g] - place[e]
        # with meeting boxes, zero or opposite turns mean a shared point
        touching = (ring[e] == ring[g]) & (gap > 1) & (gap < size[e] - 1) & (d1 * d2 <= 0) & (d3 * d4 <= 0)
        out[row[e[((d1 * d2 < 0) & (d3 * d4 < 0)) | along | touching]]] = True
    return out


def _doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


@F.arrow_udf(T.DoubleType())
def shared_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Overlap area of two polygons; 0 without a geometry."""
    return pa.array(shared_areas(Polygons(a), Polygons(b)), pa.float64())


@F.arrow_udf(T.DoubleType())
def polygon_gap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Least distance of two polygons, 0 if they share area; null without a geometry."""
    left, right = Polygons(a), Polygons(b)
    return _doubles(np.array([_gap(left, right, i) for i in range(left.n)], float))


@F.arrow_udf(T.BooleanType())
def self_crossing(rings: pa.Array) -> pa.Array:
    """Whether edges of a polygon cross, overlap, or touch where they must not."""
    return pa.array(conflicts(Polygons(rings)), pa.bool_())


def mean_boundary_distance(count: int) -> Callable:
    """Column function: mean of both directed mean distances over ``count`` exterior samples; null without a geometry."""

    @F.arrow_udf(T.DoubleType())
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = Polygons(a), Polygons(b)
        return _doubles((_directed_means(left, right, count) + _directed_means(right, left, count)) / 2)

    return distance
