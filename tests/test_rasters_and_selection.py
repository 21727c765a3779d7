import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from conftest import square
from parcelspark.operators import compare as C
from parcelspark.operators import raster as R
from parcelspark.operators.nearest import nearest_polygon, neighbours_within
from parcelspark.operators.suppression import suppress_overlaps
from parcelspark.operators import topology as T

DIMS = "raster_id long, a double, b double, c double, d double, e double, f double, height int, width int"


def frame_raster(spark):
    def value(r, c):
        ring = 10 <= r < 54 and 10 <= c < 54 and not (12 <= r < 52 and 12 <= c < 52)
        return 0.95 if ring else 0.0

    rows = [(1, r, c, value(r, c)) for r in range(64) for c in range(64)]
    pixels = spark.createDataFrame(rows, "raster_id long, row long, col long, value double")
    dims = spark.createDataFrame([(1, 1.0, 0.0, 1000.0, 0.0, -1.0, 2000.0, 64, 64)], DIMS)
    return pixels, dims


def test_frame_gives_one_enclosed_face(spark):
    pixels, dims = frame_raster(spark)
    faces = R.open_faces(pixels, "value", 0.5, 3, 0)
    found = R.parcel_faces(faces, dims, tile=16).collect()
    assert len(found) == 1 and found[0].area_m2 == 1600 and found[0].vertex_count == 4
    assert R.parcel_faces(faces, dims, tile=16, min_compactness=0.9).count() == 0
    scored = R.sample_probability(
        R.parcel_faces(faces, dims, tile=16), pixels, dims, ["raster_id", "component"]).first()
    assert 0 < scored.alignment <= 0.95


def brute_components(open_set):
    seen, out = set(), {}
    for start in sorted(open_set):
        if start in seen:
            continue
        stack, members = [start], []
        seen.add(start)
        while stack:
            r, c = stack.pop()
            members.append((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in open_set and n not in seen:
                    seen.add(n)
                    stack.append(n)
        for m in members:
            out[m] = start[0] * (1 << 31) + start[1]
    return out


@pytest.mark.parametrize("density", [0.5, 0.62])
def test_components_across_tiles(spark, density):
    rng = random.Random(3)
    open_set = {(r, c) for r in range(40) for c in range(40) if rng.random() < density}
    faces = spark.createDataFrame([(1, r, c) for r, c in open_set], "raster_id long, row long, col long")
    got = {(r.row, r.col): r.component for r in R.connected_components(faces, tile=8).collect()}
    assert got == brute_components(open_set)


def test_traced_rings_have_the_area_of_filled_components(spark):
    cells = [(r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(7, 7)]
    comp = spark.createDataFrame([(1, 5 if r < 6 else 6, r, c) for r, c in cells], "raster_id long, component long, row long, col long")
    rings = {r.component: [(p.row, p.col) for p in r.corners] for r in R.face_rings(comp).collect()}
    assert rings[5][0] == rings[5][-1] and set(rings[5]) == {(0, 0), (0, 5), (5, 5), (5, 0)}
    assert len(rings[6]) == 5


def test_closing_and_gradient(spark):
    gap = [(1, 0, c, 0 if c == 3 else 1) for c in range(8)]
    df = spark.createDataFrame(gap, "raster_id long, row long, col long, m int")
    assert [r.m for r in R.close_mask(df, "m", 3, 0).orderBy("col").collect()] == [1] * 8
    ramp = spark.createDataFrame(
        [(1, r, c, float(c * c + 3 * r)) for r in range(3) for c in range(4)], "raster_id long, row long, col long, v double")
    got = {(x.row, x.col): x.magnitude for x in R.gradient_magnitude(ramp, "v").collect()}
    assert got[(0, 0)] == pytest.approx((1 + 9) ** 0.5) and got[(1, 1)] == pytest.approx((4 + 9) ** 0.5)


def random_boxes(n, seed, side=8):
    rng = random.Random(seed)
    return [(0, i, [square(rng.randint(0, 40), rng.randint(0, 40), rng.randint(2, side), rng.randint(2, side))]) for i in range(n)]


def inter(a, b):
    (ax, ay), (aX, aY) = a[0], a[2]
    (bx, by), (bX, bY) = b[0], b[2]
    return max(0, min(aX, bX) - max(ax, bx)) * max(0, min(aY, bY) - max(ay, by))


def size(a):
    return (a[2][0] - a[0][0]) * (a[2][1] - a[0][1])


def test_suppression_equals_sequential_greedy(make_layer):
    rows = random_boxes(60, 11) + [(0, 100 + i, [square(3, 3, 9)]) for i in range(4)]
    accepted = []
    for p, i, r in sorted(rows, key=lambda t: (-size(t[2][0]), t[1])):
        if all(inter(r[0], o) <= 0.01 for _, o in accepted):
            accepted.append((i, r[0]))
    got = {r.id for r in suppress_overlaps(make_layer(rows), ["project_id"]).collect()}
    assert got == {i for i, _ in accepted}


def test_overlap_pairs_totals_and_flags(make_layer):
    rows = random_boxes(50, 4) + [(0, 100 + i, [square(3, 3, 9)]) for i in range(3)]
    layer = make_layer(rows)
    want = {(a[1], b[1]): inter(a[2][0], b[2][0]) for a in rows for b in rows if a[1] < b[1] and inter(a[2][0], b[2][0]) > 1}
    got = {(r.l_id, r.r_id): r.inter_area for r in T.overlap_pairs(layer, ["project_id"]).collect()}
    assert got == pytest.approx(want)
    total = T.overlap_totals(layer, ["project_id"], eps=1.0).first()
    assert total.overlap_pairs == len(want) and total.overlap_area == pytest.approx(sum(want.values()))
    flags = {r.id for r in T.overlap_flags(layer, ["project_id"]).collect()}
    assert flags == {i for a in rows for b in rows for i in (a[1],)
                     if a[1] != b[1] and 1e-6 < inter(a[2][0], b[2][0]) < min(size(a[2][0]), size(b[2][0])) - 1e-6}


def test_nearest_and_neighbours(make_layer):
    src = [(0, i, [square(i * 37 % 101, i * 53 % 97, 2)]) for i in range(12)] + [(9, 99, [square(0, 0, 1)])]
    tgt = [(0, i, [square(i * 29 % 211, i * 61 % 193, 3)]) for i in range(10)]

    def gap(a, b):
        dx = max(a[0][0] - b[2][0], b[0][0] - a[2][0], 0)
        dy = max(a[0][1] - b[2][1], b[0][1] - a[2][1], 0)
        return (dx * dx + dy * dy) ** 0.5

    got = {r.source_id: (r.target_id, round(r.distance, 9)) for r in nearest_polygon(
        make_layer(src), make_layer(tgt), ["project_id"], radius=2.0).collect()}
    want = {s[1]: min((round(gap(s[2][0], t[2][0]), 9), t[1]) for t in tgt)[::-1] for s in src if s[0] == 0}
    assert got == want
    near = {(r.l_id, r.r_id) for r in neighbours_within(make_layer(src[:-1]), ["project_id"], 15.0).collect()}
    assert near == {(a[1], b[1]) for a in src[:-1] for b in src[:-1] if a[1] < b[1] and gap(a[2][0], b[2][0]) < 15}


def test_compare_identical_layers_and_empty_target(make_layer):
    rows = [(0, i, [square(i * 20, 0, 10)]) for i in range(4)]
    row = C.compare_layers(make_layer(rows), make_layer(rows), ["project_id"], 5.0).first()
    assert row.harmonic_mean_best_iou == pytest.approx(1) and row.reference_matched_iou_75 == 4
    assert row.mean_symmetric_boundary_distance_m == pytest.approx(0, abs=1e-9)
    assert row.median_candidate_area_m2 == 100
    none = C.best_iou(make_layer(rows), make_layer(rows).limit(0), ["project_id"])
    assert [r.best_iou for r in none.collect()] == [0, 0, 0, 0]


def walked(pixels):
    """Exterior ring by walking a dense grid corner by corner."""
    rows, cols = zip(*pixels)
    r0, c0 = min(rows) - 1, min(cols) - 1
    inside = {(r - r0, c - c0) for r, c in pixels}
    moves = ((0, 1), (1, 0), (0, -1), (-1, 0))
    at, heading = min(inside), 0
    start, ring = (at, heading), [at]
    while True:
        at = (at[0] + moves[heading][0], at[1] + moves[heading][1])
        y, x = at
        right, left = (((y, x), (y - 1, x)), ((y, x - 1), (y, x)), ((y - 1, x - 1), (y, x - 1)), ((y - 1, x), (y - 1, x - 1)))[heading]
        turned = (heading + 1) % 4 if right not in inside else (heading + 3) % 4 if left in inside else heading
        if turned != heading:
            ring.append(at)
        heading = turned
        if (at, heading) == start:
            break
    ring = ring if ring[-1] == ring[0] else [*ring, ring[0]]
    return [(float(y + r0), float(x + c0)) for y, x in ring]


def test_rings_from_edges_equal_a_walk():
    rng = random.Random(2)
    for _ in range(200):
        grid = {(r, c) for r in range(9) for c in range(9) if rng.random() < 0.62}
        seed = min(grid)
        component, todo = {seed}, [seed]
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p in grid and p not in component:
                    component.add(p)
                    todo.append(p)
        codes = np.array(rng.sample([r * R._SHIFT + c for r, c in component], len(component)))
        rows, cols = R._trace(codes)
        assert list(zip(rows.tolist(), cols.tolist())) == walked(component)


def test_a_thin_net_twenty_thousand_pixels_wide():
    """A dense box of it would hold 400 million cells."""
    import tracemalloc

    n = 20_000
    line = np.arange(n, dtype=np.int64)
    codes = np.unique(np.concatenate([5 * R._SHIFT + line, line * R._SHIFT + 7, (n - 1) * R._SHIFT + line]))
    tracemalloc.start()
    rows, cols = R._trace(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    area = abs((rows[:-1] * cols[1:] - rows[1:] * cols[:-1]).sum()) / 2
    assert area == len(codes) and (rows.max(), cols.max()) == (n, n)
