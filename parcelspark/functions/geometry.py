"""Polygon measures as column expressions.

A polygon is ``rings: array<array<struct<x:double,y:double>>>``: ring 0 is the
exterior, the others are holes, every ring repeats its first position at the
end. All measures run inside the row, so they never shuffle.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import computed_once

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"
RING_TYPE = "array<struct<x:double,y:double>>"

# Fixed value: mean Earth radius in metres used by the on-screen measures.
EARTH_RADIUS_M = 6371008.8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Closed counter-clockwise rectangle."""
    return ring([(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)])


def box_polygon(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(box_ring(minx, miny, maxx, maxy))


def exterior(rings: Column | str) -> Column:
    return F.element_at(_col(rings), 1)


def holes(rings: Column | str) -> Column:
    r = _col(rings)
    return F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))


def without_holes(rings: Column | str) -> Column:
    return F.slice(_col(rings), 1, 1)


def ring_edges(r: Column | str) -> Column:
    """array<struct<x1,y1,x2,y2>> of consecutive positions."""
    r = _col(r)
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.zip_with(
        F.slice(r, 1, n),
        F.slice(r, 2, n),
        lambda p, q: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
        ),
    )


def polygon_edges(rings: Column | str) -> Column:
    """Edges of all rings of a polygon, flattened."""
    return F.flatten(F.transform(_col(rings), ring_edges))


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def ring_signed_area(r: Column | str) -> Column:
    """Shoelace sum about the first position; positive when counter-clockwise."""
    r = _col(r)
    x0, y0 = r[0]["x"], r[0]["y"]
    return _sum(
        ring_edges(r),
        lambda e: ((e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)) / 2.0,
    )


def polygon_area(rings: Column | str) -> Column:
    """Planar area with the holes taken off."""
    r = _col(rings)
    return F.abs(ring_signed_area(exterior(r))) - _sum(
        holes(r), lambda h: F.abs(ring_signed_area(h))
    )


def ring_length(r: Column | str) -> Column:
    return _sum(ring_edges(r), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def perimeter(rings: Column | str) -> Column:
    """Planar length of all rings."""
    return _sum(_col(rings), ring_length)


def bbox(rings: Column | str) -> Column:
    ext = exterior(rings)
    xs, ys = F.transform(ext, lambda p: p["x"]), F.transform(ext, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def with_bbox(df, rings: str = "rings", prefix: str = ""):
    """Add ``minx,miny,maxx,maxy`` (one pass over the exterior)."""
    names = ["minx", "miny", "maxx", "maxy"]
    return computed_once(df, _bbox=bbox(rings)).select(
        *df.columns, *[F.col("_bbox")[n].alias(prefix + n) for n in names]
    )


def inset_box(minx: Column, miny: Column, maxx: Column, maxy: Column, d: float) -> Column:
    """Box shrunk by ``d`` on every side."""
    return F.struct(
        (minx + d).alias("minx"), (miny + d).alias("miny"),
        (maxx - d).alias("maxx"), (maxy - d).alias("maxy"),
    )


def _ring_moments(r: Column) -> Column:
    x0, y0 = r[0]["x"], r[0]["y"]

    def step(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        cross = ax * by - bx * ay
        return F.struct(
            (acc["a"] + cross / 2.0).alias("a"),
            (acc["mx"] + (ax + bx) * cross / 6.0).alias("mx"),
            (acc["my"] + (ay + by) * cross / 6.0).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    # Moments relative to the ring's first position, shifted back to map axes.
    return F.aggregate(
        ring_edges(r),
        zero,
        step,
        lambda m: F.struct(
            F.abs(m["a"]).alias("a"),
            (F.signum(m["a"]) * m["mx"] + F.abs(m["a"]) * x0).alias("mx"),
            (F.signum(m["a"]) * m["my"] + F.abs(m["a"]) * y0).alias("my"),
        ),
    )


def centroid(rings: Column | str) -> Column:
    """Area centroid of a polygon, holes removed."""
    r = _col(rings)
    first = _ring_moments(exterior(r))
    total = F.aggregate(
        F.transform(holes(r), _ring_moments),
        first,
        lambda acc, m: F.struct(
            (acc["a"] - m["a"]).alias("a"),
            (acc["mx"] - m["mx"]).alias("mx"),
            (acc["my"] - m["my"]).alias("my"),
        ),
        lambda m: F.struct((m["mx"] / m["a"]).alias("x"), (m["my"] / m["a"]).alias("y")),
    )
    return total


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def compactness(area: Column, length: Column) -> Column:
    """4*pi*A/P^2, 0 for a zero-length boundary."""
    return F.when(length > 0, 4 * pi * area / (length * length)).otherwise(F.lit(0.0))


def vertex_count(rings: Column | str) -> Column:
    """Distinct exterior vertices."""
    return F.size(exterior(rings)) - 1


def total_vertex_count(rings: Column | str) -> Column:
    return F.aggregate(
        _col(rings), F.lit(0), lambda acc, r: acc + F.greatest(F.size(r) - 1, F.lit(0))
    )


def spherical_ring_area(r: Column | str) -> Column:
    """Ring area on a sphere from the trapezoid sum over longitude (degrees in)."""
    total = _sum(
        ring_edges(r),
        lambda e: F.radians(e["x2"] - e["x1"])
        * (2.0 + F.sin(F.radians(e["y1"])) + F.sin(F.radians(e["y2"]))),
    )
    return F.abs(total * EARTH_RADIUS_M * EARTH_RADIUS_M / 2.0)


def spherical_area(rings: Column | str) -> Column:
    r = _col(rings)
    return F.greatest(
        F.lit(0.0),
        spherical_ring_area(exterior(r)) - _sum(holes(r), spherical_ring_area),
    )


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((p2 - p1) / 2.0), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2.0), 2
    )
    return 2.0 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def haversine_perimeter(rings: Column | str) -> Column:
    """Great-circle length of all rings."""
    return _sum(
        _col(rings),
        lambda r: _sum(ring_edges(r), lambda e: haversine(e["x1"], e["y1"], e["x2"], e["y2"])),
    )


def map_points(rings: Column | str, fn) -> Column:
    """Apply ``fn(x, y) -> struct<x,y>`` to every position."""
    return F.transform(_col(rings), lambda r: F.transform(r, lambda p: fn(p["x"], p["y"])))


def equals_exact(a: Column | str, b: Column | str, tolerance: float = 1e-12) -> Column:
    """Same structure and every coordinate within ``tolerance``."""
    a, b = _col(a), _col(b)

    def same_ring(r: Column, s: Column) -> Column:
        return (F.size(r) == F.size(s)) & F.forall(
            F.zip_with(
                r, s,
                lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance)
                & (F.abs(p["y"] - q["y"]) <= tolerance),
            ),
            lambda ok: F.coalesce(ok, F.lit(False)),
        )

    return (F.size(a) == F.size(b)) & F.forall(
        F.zip_with(a, b, same_ring), lambda ok: F.coalesce(ok, F.lit(False))
    )


def open_ring(r: Column | str, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    """Drop a closing position that repeats the first one."""
    r = _col(r)
    first, last = r[0], F.element_at(r, -1)
    closed = (F.size(r) > 1) & (
        F.abs(first["x"] - last["x"]) <= atol + rtol * F.abs(last["x"])
    ) & (F.abs(first["y"] - last["y"]) <= atol + rtol * F.abs(last["y"]))
    return F.when(closed, F.slice(r, 1, F.size(r) - 1)).otherwise(r)


def mean_displacement(current: Column | str, original: Column | str) -> Column:
    """Mean distance of matching vertices of two open rings, cut to the shorter one."""
    cur, org = _col(current), _col(original)
    n = F.least(F.size(cur), F.size(org))
    moved = F.zip_with(F.slice(cur, 1, n), F.slice(org, 1, n), distance)
    return F.when(n > 0, _sum(moved, lambda d: d) / n).otherwise(F.lit(0.0))


def deviation_term(current: Column | str, original: Column | str, original_area: Column) -> Column:
    """Mean displacement over the radius of a circle with the original area."""
    scale = F.when(original_area > 0, F.sqrt(original_area / pi)).otherwise(F.lit(1.0))
    return mean_displacement(current, original) / F.greatest(scale, F.lit(1e-6))


def boundary_lines(rings: Column | str) -> Column:
    """Rings as lines: the boundary of a polygon."""
    return _col(rings)


def pixel_of(x: Column, y: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Map position -> (row, col) by inverting x=a*col+b*row+c, y=d*col+e*row+f."""
    det = a * e - b * d
    col = (e * (x - c) - b * (y - f)) / det
    row = (a * (y - f) - d * (x - c)) / det
    return F.struct(F.floor(row).cast("long").alias("row"), F.floor(col).cast("long").alias("col"))


def map_of(row: Column, col: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """(row, col) corner -> map position."""
    return point(a * col + b * row + c, d * col + e * row + f)


def to_wkt(rings: Column | str) -> Column:
    """POLYGON ((x y, ...), ...)."""
    body = F.transform(
        _col(rings),
        lambda r: F.concat(
            F.lit("("),
            F.array_join(
                F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))),
                ", ",
            ),
            F.lit(")"),
        ),
    )
    return F.concat(F.lit("POLYGON ("), F.array_join(body, ", "), F.lit(")"))


def from_wkt(text: Column | str) -> Column:
    """Parse the POLYGON text produced by :func:`to_wkt` (and any plain 2-D POLYGON)."""
    inner = F.regexp_replace(F.trim(_col(text)), r"(?i)^POLYGON\s*\(\s*\(|\)\s*\)$", "")
    return F.transform(
        F.split(inner, r"\)\s*,\s*\("),
        lambda r: F.transform(
            F.split(F.trim(r), r"\s*,\s*"),
            lambda p: point(F.split(p, r"\s+")[0], F.split(p, r"\s+")[1]),
        ),
    )


def to_coordinates(rings: Column | str) -> Column:
    """GeoJSON nesting: array<array<array<double>>>."""
    return F.transform(
        _col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    )


def from_coordinates(coordinates: Column | str) -> Column:
    return F.transform(
        _col(coordinates), lambda r: F.transform(r, lambda p: point(p[0], p[1]))
    )


def geojson_geometry(rings: Column | str) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), to_coordinates(rings).alias("coordinates"))
