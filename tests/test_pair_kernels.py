"""Pair kernels against edge-by-edge versions, on small shapes and on boundaries with very many vertices."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from parcelspark.operators import pair_kernels as K
from parcelspark.operators.shapes import _ARROW_RINGS


def star(rng, cx, cy, size, n, rough=0.6):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(cx + size * rng.uniform(1 - rough, 1) * math.cos(t), cy + size * rng.uniform(1 - rough, 1) * math.sin(t)) for t in turns]
    return [*pts, pts[0]]


def wavy(cx, cy, size, n, waves):
    pts = [(cx + size * (1 + 0.05 * math.sin(waves * t)) * math.cos(t), cy + size * (1 + 0.05 * math.sin(waves * t)) * math.sin(t))
           for t in (2 * math.pi * i / n for i in range(n))]
    return [*pts, pts[0]]


def column(polygons):
    return K.Polygons(pa.array([p and [[{"x": x, "y": y} for x, y in r] for r in p] for p in polygons], _ARROW_RINGS))


def edges(p):
    return [(*u, *v) for r in p or [] for u, v in zip(r, r[1:])]


def gap_to(px, py, e):
    x1, y1, x2, y2 = e
    dx, dy = x2 - x1, y2 - y1
    t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def brute_area(a, b, n=400):
    """Area by many horizontal cuts."""
    def spans(p, y):
        xs = sorted(x1 + (y - y1) / (y2 - y1) * (x2 - x1) for x1, y1, x2, y2 in edges(p) if (y1 > y) != (y2 > y))
        return list(zip(xs[::2], xs[1::2]))

    ys = [y for p in (a, b) for r in p for _, y in r]
    low, high = min(ys), max(ys)
    step, total = (high - low) / n, 0.0
    for k in range(n):
        y = low + (k + 0.5) * step
        total += step * sum(max(0.0, min(u[1], v[1]) - max(u[0], v[0])) for u in spans(a, y) for v in spans(b, y))
    return total


def brute_mean(a, b, count):
    ring = [e for e in edges(a[:1]) if e[:2] != e[2:]]
    lengths = [math.hypot(e[2] - e[0], e[3] - e[1]) for e in ring]
    step, out = sum(lengths) / count, 0.0
    for k in range(count):
        at, i = k * step, 0
        while i < len(ring) - 1 and at >= lengths[i]:
            at, i = at - lengths[i], i + 1
        x1, y1, x2, y2 = ring[i]
        px, py = x1 + at / lengths[i] * (x2 - x1), y1 + at / lengths[i] * (y2 - y1)
        out += min(gap_to(px, py, e) for e in edges(b))
    return out / count


@pytest.fixture(params=[False, True])
def indexed(request, monkeypatch):
    """Small shapes go through the range lookup too, and through small parts."""
    if request.param:
        monkeypatch.setattr(K, "INDEXED", 0)
        monkeypatch.setattr(K, "AT_ONCE", 7)
    return request.param


def shapes():
    rng = random.Random(3)
    out = []
    for k in range(60):
        a = [star(rng, 0, 0, 10, rng.randrange(3, 12))]
        b = [star(rng, rng.uniform(-14, 14), rng.uniform(-14, 14), rng.uniform(2, 12), rng.randrange(3, 12))[:: rng.choice((1, -1))]]
        if k % 4 == 0:
            a = [[(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], [(-4, -4), (4, -4), (4, 4), (-4, 4), (-4, -4)]]
            b = [star(rng, rng.choice((0, 0.5, 6)), 0, rng.uniform(1, 3), 7)]
        out.append((a, b))
    return out


def test_areas_and_distances_equal_edge_by_edge_versions(indexed):
    pairs = shapes()
    a, b = column([p[0] for p in pairs]), column([p[1] for p in pairs])
    areas = K.shared_areas(a, b)
    means = (K._directed_means(a, b, 24) + K._directed_means(b, a, 24)) / 2
    for i, (p, q) in enumerate(pairs):
        assert areas[i] == pytest.approx(brute_area(p, q), abs=1.5)
        assert means[i] == pytest.approx((brute_mean(p, q, 24) + brute_mean(q, p, 24)) / 2)
        gap = min(min(gap_to(e[0], e[1], g), gap_to(g[0], g[1], e)) for e in edges(p) for g in edges(q))
        assert K._gap(a, b, i) == pytest.approx(0 if areas[i] > 1e-9 else gap, abs=1e-12)
    assert (areas > 1e-9).any() and (areas <= 1e-9).any()


def test_rows_without_a_geometry():
    box = [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]]
    a, b = column([None, box, [], box, [[]], box, box]), column([box, None, box, [], box, [[(1, 1)]], box])
    assert K.shared_areas(a, b).tolist() == [0, 0, 0, 0, 0, 0, 4]
    assert np.isnan([K._gap(a, b, i) for i in range(6)]).all() and K._gap(a, b, 6) == 0
    assert np.isnan(K._directed_means(a, b, 8)[:6]).all() and K._directed_means(a, b, 8)[6] == 0
    assert K.shared_areas(column([]), column([])).tolist() == []


def test_boundaries_of_twenty_thousand_vertices():
    n, start = 20_000, time.perf_counter()
    # the second circle is the first one moved: the lens of two discs, up to the waves' share
    a, b, far = column([[wavy(0, 0, 100, n, 0)]]), column([[wavy(60, 0, 100, n, 0)]]), column([[wavy(230, 0, 100, n, 9)]])
    lens = 2 * 100**2 * math.acos(0.3) - 30 * math.sqrt(4 * 100**2 - 60**2)
    assert K.shared_areas(a, b)[0] == pytest.approx(lens, rel=1e-5)
    assert K._gap(a, b, 0) == 0
    nearest = min(math.hypot(x, y) for x, y in wavy(230, 0, 100, n, 9)) - 100
    assert K._gap(a, far, 0) == pytest.approx(nearest, abs=1e-4)
    assert K._directed_means(a, far, 96)[0] > 25
    assert time.perf_counter() - start < 20


def test_long_boundaries_equal_all_edge_pairs(monkeypatch):
    a, b = column([[wavy(0, 0, 100, 1500, 40)]]), column([[wavy(3, 1, 100, 1400, 31)]])
    quick = K.shared_areas(a, b)[0]
    monkeypatch.setattr(K, "INDEXED", 1 << 60)
    assert quick == pytest.approx(K.shared_areas(a, b)[0], rel=1e-12)


def brute_conflict(p):
    kept = [(r, [e for e in edges([ring]) if e[:2] != e[2:]]) for r, ring in enumerate(p)]
    listed = [(r, i, len(es), e) for r, es in kept for i, e in enumerate(es)]

    def side(e, x, y):
        v = (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])
        return (v > 0) - (v < 0)

    for k, (r, i, n, e) in enumerate(listed):
        for s, j, _, g in listed[k + 1:]:
            box = all(min(e[a], e[a + 2]) <= max(g[a], g[a + 2]) and min(g[a], g[a + 2]) <= max(e[a], e[a + 2]) for a in (0, 1))
            if not box:
                continue
            d = [side(g, e[0], e[1]), side(g, e[2], e[3]), side(e, g[0], g[1]), side(e, g[2], g[3])]
            common = max(min(max(e[a], e[a + 2]), max(g[a], g[a + 2])) - max(min(e[a], e[a + 2]), min(g[a], g[a + 2])) for a in (0, 1))
            crossing, along = d[0] * d[1] < 0 and d[2] * d[3] < 0, d[0] == d[1] == 0 and common > 0
            if crossing or along or (r == s and 1 < j - i < n - 1 and d[0] * d[1] <= 0 and d[2] * d[3] <= 0):
                return True
    return False


def test_conflicting_edges_equal_all_edge_pairs(indexed):
    rng = random.Random(11)
    cases = [None, [], [[]], [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], [[(0, 0), (4, 0), (2, 0), (2, 3), (0, 0)]]]
    for _ in range(300):
        n = rng.randrange(3, 9)
        ring = [(rng.randrange(6), rng.randrange(6)) for _ in range(n)]
        cases.append([[*ring, ring[0]]] if rng.random() < 0.7 else [star(rng, 0, 0, 9, n), [*ring, ring[0]]])
    found = K.conflicts(column(cases)).tolist()
    assert found == [bool(p) and brute_conflict([r for r in p]) for p in cases]
    assert 20 < sum(found) < 300


def test_a_crossing_among_twenty_thousand_vertices_is_found():
    ring = wavy(0, 0, 100, 20_000, 25)
    crossed = [*ring[:5000], (0.0, -120.0), *ring[5001:]]
    assert K.conflicts(column([[ring], [crossed]])).tolist() == [False, True]
