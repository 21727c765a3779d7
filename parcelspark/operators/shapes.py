"""Arrow kernels whose result is a new geometry: hull size, line clipping, simplification.

Each kernel maps a batch of polygons; none of them holds state between rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import RingRows

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
RINGS = T.ArrayType(RING)
_ARROW_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

# Handles kept when a boundary is opened for editing.
DETAILED_AREA = 5_000.0
DETAILED_VERTICES = 40
OUTER_HANDLES = (10, 5)
HOLE_HANDLES = 4


POINTS_AT_ONCE = 1 << 18  # positions of whole rings that are simplified together


def _points(ring) -> np.ndarray:
    if ring is None or len(ring) == 0:
        return np.empty((0, 2))
    return np.array([(p["x"], p["y"]) for p in ring], dtype=np.float64)


def _ring(points: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in points]


def _hull_size(points: np.ndarray) -> int:
    """Vertices of the convex hull without collinear ones; 1 for a degenerate hull."""
    unique = np.unique(points, axis=0)
    if len(unique) < 3:
        return 1

    def half(order) -> list:
        chain: list = []
        for p in order:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain

    corners = len(half(unique)) + len(half(unique[::-1])) - 2
    return corners if corners >= 3 else 1


@F.arrow_udf(T.IntegerType())
def hull_vertex_count(rings: pa.Array) -> pa.Array:
    return pa.array([_hull_size(_points(r[0])) for r in rings.to_pylist()], pa.int32())


def _keep_far(xy: np.ndarray, at: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker mask over the points of many lines (line k: at[k] .. at[k+1]); ends are kept.

    All spans of one depth, of all lines, are measured together; of equal gaps the first point splits a span.
    """
    keep = np.zeros(len(xy), dtype=bool)
    lines = np.flatnonzero(np.diff(at) > 0)
    first, last = at[lines], at[lines + 1] - 1
    keep[first] = keep[last] = True
    x, y = xy[:, 0], xy[:, 1]
    while True:
        wide = last - first >= 2
        first, last = first[wide], last[wide]
        if not len(first):
            return keep
        n = last - first - 1
        offset = np.cumsum(n) - n
        span = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(span)) + np.repeat(first + 1 - offset, n)
        dx, dy = x[last] - x[first], y[last] - y[first]
        length = dx * dx + dy * dy
        ax, ay, dx, dy, length = x[first][span], y[first][span], dx[span], dy[span], length[span]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(length != 0, np.clip(((x[inner] - ax) * dx + (y[inner] - ay) * dy) / length, 0, 1), 0.0)
        gaps = np.hypot(x[inner] - (ax + t * dx), y[inner] - (ay + t * dy))
        most = np.maximum.reduceat(gaps, offset)
        top = np.flatnonzero((gaps == most[span]) & (gaps > tolerance))
        split, at_top = np.unique(span[top], return_index=True)
        middle = inner[top[at_top]]
        keep[middle] = True
        first, last = np.concatenate([first[split], middle]), np.concatenate([middle, last[split]])


def simplify_rings(tolerance: float):
    """Column function: drop positions closer than ``tolerance`` to the simpler line."""

    @F.arrow_udf(RINGS)
    def simplify(rings: pa.Array) -> pa.Array:
        rows = RingRows(rings)
        at = rows.ring_at
        keep = np.zeros(len(rows.xy), bool)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + POINTS_AT_ONCE, "right")) - 1)
            keep[at[i]:at[j]] = _keep_far(rows.xy[at[i]:at[j]], at[i:j + 1] - at[i], tolerance)
            i = j
        kept = np.add.reduceat(np.append(keep, False), at[:-1], dtype=np.int64) if len(at) > 1 else np.empty(0, np.int64)
        small = (kept < 4) | (np.diff(at) == 0)
        keep |= np.repeat(small, np.diff(at))
        sizes = np.where(small, np.diff(at), kept)
        return rows.with_points(rows.xy[keep], sizes)

    return simplify


def _drop_flattest(points: np.ndarray, target: int) -> np.ndarray:
    """Remove the corner of the smallest triangle again and again; first one on a tie."""
    pts = points
    goal = max(3, min(target, len(pts)))
    while len(pts) > goal:
        before, after = np.roll(pts, 1, axis=0), np.roll(pts, -1, axis=0)
        sizes = np.abs(
            before[:, 0] * (pts[:, 1] - after[:, 1])
            + pts[:, 0] * (after[:, 1] - before[:, 1])
            + after[:, 0] * (before[:, 1] - pts[:, 1])) / 2
        pts = np.delete(pts, int(np.argmin(sizes)), axis=0)
    return pts


@F.arrow_udf(RINGS)
def editing_rings(rings: pa.Array, ring_area: pa.Array) -> pa.Array:
    """Rings reduced to a few edit handles: 10 for large or detailed exteriors, else 5; holes 4."""
    def one(r, area):
        out = []
        for i, g in enumerate(r):
            open_points = _points(g)[:-1]
            detailed = area >= DETAILED_AREA or len(open_points) > DETAILED_VERTICES
            target = HOLE_HANDLES if i else OUTER_HANDLES[0 if detailed else 1]
            kept = _drop_flattest(open_points, target)
            out.append(_ring(np.vstack([kept, kept[:1]])))
        return out

    return pa.array([one(r, a) for r, a in zip(rings.to_pylist(), ring_area.to_pylist())], _ARROW_RINGS)


def _clip_segment(x1, y1, x2, y2, box):
    t0, t1, dx, dy = 0.0, 1.0, x2 - x1, y2 - y1
    for p, q in ((-dx, x1 - box[0]), (dx, box[2] - x1), (-dy, y1 - box[1]), (dy, box[3] - y1)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return None if t0 > t1 else (x1 + t0 * dx, y1 + t0 * dy, x1 + t1 * dx, y1 + t1 * dy)


@F.arrow_udf(RINGS)
def clip_lines(lines: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    """Lines cut to a box; a line that leaves and returns gives several parts."""
    def one(parts, *box):
        out: list[list[tuple[float, float]]] = []
        for line in parts:
            pts = _points(line)
            current: list[tuple[float, float]] = []
            for (x1, y1), (x2, y2) in zip(pts[:-1], pts[1:]):
                cut = _clip_segment(x1, y1, x2, y2, box)
                if cut is None or (cut[0], cut[1]) == (cut[2], cut[3]):
                    continue
                if current and current[-1] == (cut[0], cut[1]):
                    current.append((cut[2], cut[3]))
                else:
                    if current:
                        out.append(current)
                    current = [(cut[0], cut[1]), (cut[2], cut[3])]
            if current:
                out.append(current)
        return [_ring(np.array(part)) for part in out] or None

    columns = [c.to_pylist() for c in (lines, minx, miny, maxx, maxy)]
    return pa.array([one(*v) for v in zip(*columns)], _ARROW_RINGS)
