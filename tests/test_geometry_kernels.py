import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import RINGS, square, to_rings
from parcelspark.functions import geometry as G
from parcelspark.functions import projection as P
from parcelspark.operators import shapes as A
from parcelspark.operators.boundary import boundary_samples, polygon_distance, symmetric_boundary_distance
from parcelspark.operators.grid import cross_candidates, self_candidates
from parcelspark.operators.overlay import intersection_area
from parcelspark.operators.validity import invalid_reason


def one(df, *cols):
    return df.select(*cols).first()


def test_areas_lengths_and_counts(make_layer):
    layer = make_layer([(0, 1, [square(0, 0, 10), square(2, 2, 2)[::-1]])])
    row = one(layer, G.polygon_area("rings").alias("a"), G.perimeter("rings").alias("p"),
              G.vertex_count("rings").alias("v"), G.total_vertex_count("rings").alias("t"),
              G.centroid("rings").alias("c"), G.to_wkt("rings").alias("w"))
    assert row.a == 96 and row.p == 48 and row.v == 4 and row.t == 8
    assert row.c.x == pytest.approx((100 * 5 - 4 * 3) / 96)
    assert row.w.startswith("POLYGON ((0.0 0.0, 10.0 0.0")
    back = one(layer.select(G.from_wkt(G.to_wkt("rings")).alias("rings"), F.col("rings").alias("o")),
               G.equals_exact("rings", "o").alias("same"))
    assert back.same


def test_geodesic_area_and_utm(spark, make_layer):
    layer = make_layer([(0, 1, [[(-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90)]])])
    assert one(layer, P.geodesic_area("rings").alias("a")).a == pytest.approx(5.1006562e14, rel=1e-6)
    row = spark.range(1).select(P.utm_forward(F.lit(87.0), F.lit(23.5), 45).alias("p")).first().p
    # on the central meridian: false easting, 0.9996 times the meridian arc
    assert row.x == pytest.approx(500000.0, abs=1e-6)
    e2 = 0.00669437999014
    steps, arc, a = 20000, 0.0, 6378137.0
    for i in range(steps):
        phi = math.radians(23.5) * (i + 0.5) / steps
        arc += a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5 * math.radians(23.5) / steps
    assert row.y == pytest.approx(0.9996 * arc, abs=1e-3)
    there = spark.range(1).select(P.utm_inverse(F.lit(512345.6), F.lit(2598765.4), 45).alias("p"))
    back = there.select(P.utm_forward(F.col("p.x"), F.col("p.y"), 45).alias("q")).first().q
    assert back.x == pytest.approx(512345.6, abs=1e-6) and back.y == pytest.approx(2598765.4, abs=1e-6)


@pytest.mark.parametrize("rings,reason", [
    ([square(0, 0, 10)], None),
    ([square(0, 0, 10), square(2, 2, 2)], None),
    ([[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]], "zero_area"),
    ([[(0, 0), (10, 8), (10, 0), (0, 10), (0, 0)]], "self_intersection"),
    ([[(0, 0), (10, 0), (10, 10), (0, 10)]], "not_closed"),
    ([[(0, 0), (10, 0), (0, 0)]], "too_few_positions"),
    ([[(0, 0), (4, 0), (4, 4), (8, 4), (8, 8), (4, 8), (4, 4), (0, 4), (0, 0)]], "self_intersection"),
    ([[(0, 0), (10, 0), (5, 0), (5, 5), (0, 0)]], "self_intersection"),
    ([[(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (0, 0)]], None),
    ([square(0, 0, 10), square(8, 8, 4)], "self_intersection"),
    ([square(0, 0, 10), square(0, 2, 2)], "self_intersection"),
])
def test_validity(make_layer, rings, reason):
    assert one(make_layer([(0, 1, rings)]), invalid_reason("rings").alias("r")).r == reason


def clip_area(subject, clipper):
    """Sutherland-Hodgman against a convex counter-clockwise clipper."""
    out = subject[:-1]
    for (ax, ay), (bx, by) in zip(clipper[:-1], clipper[1:]):
        points, out = out, []
        for i, p in enumerate(points):
            q = points[i - 1]
            side = lambda s: (bx - ax) * (s[1] - ay) - (by - ay) * (s[0] - ax)
            if (side(p) >= 0) != (side(q) >= 0):
                t = side(q) / (side(q) - side(p))
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if side(p) >= 0:
                out.append(p)
        if not out:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2


def star(rng, cx, cy, n, spread=True):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(cx + (r := rng.uniform(3, 9) if spread else 8) * math.cos(a), cy + r * math.sin(a)) for a in angles]
    return pts + [pts[0]]


def test_intersection_area_against_clipping(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for i in range(120):
        a = star(rng, 0, 0, rng.randint(5, 14))
        b = star(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), rng.randint(4, 9), spread=False)
        expected[i] = clip_area(a, b)
        if i % 2:
            a = a[::-1]
        rows.append((i, [[{"x": x, "y": y} for x, y in a]], [[{"x": x, "y": y} for x, y in b]]))
    df = spark.createDataFrame(rows, f"k int, a {G.RINGS_TYPE}, b {G.RINGS_TYPE}")
    got = {r.k: r.inter_area for r in intersection_area(df, ["k"], "a", "b").collect()}
    # angles may wrap so that the clipper is not around its centre; skip none, compare all
    assert max(abs(got[k] - expected[k]) for k in expected) < 1e-9


def boxes_layer(make_layer, n=150, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side = rng.choice([0.3, 1, 1, 2, 17, 40]) * rng.uniform(0.5, 1)
        rows.append((i % 2, i, [square(rng.uniform(-50, 50), rng.uniform(-50, 50), side, side * rng.uniform(0.2, 1))]))
    return rows, make_layer(rows)


def meet(a, b, margin=0.0):
    (ax, ay), (aX, aY) = a[0], a[2]
    (bx, by), (bX, bY) = b[0], b[2]
    m = 2 * margin
    return ax <= bX + m and bx <= aX + m and ay <= bY + m and by <= aY + m


@pytest.mark.parametrize("margin,per_cell", [(0.0, 10_000), (1.5, 10_000), (0.0, 2), (1.5, 2)])
def test_grid_pairs_equal_brute_force(make_layer, margin, per_cell):
    rows, layer = boxes_layer(make_layer)
    boxed = G.with_bbox(layer)
    got = [(r.l_id, r.r_id) for r in self_candidates(
        boxed, ["project_id"], [], margin=margin, objects_per_cell=per_cell).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows
            if a[1] < b[1] and a[0] == b[0] and meet(a[2][0], b[2][0], margin)}
    assert len(got) == len(set(got)) and set(got) == want
    rows2, layer2 = boxes_layer(make_layer, 130, seed=5)
    got = [(r.l_id, r.r_id) for r in cross_candidates(
        boxed, G.with_bbox(layer2), ["project_id"], [], [], margin=margin, objects_per_cell=per_cell).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows2 if a[0] == b[0] and meet(a[2][0], b[2][0], margin)}
    assert len(got) == len(set(got)) and set(got) == want


def test_samples_and_distances(spark, make_layer):
    layer = make_layer([(0, 1, [square(0, 0, 10)])])
    points = [(r.sample, r.sx, r.sy) for r in boundary_samples(layer, ["id"], "rings", 8).orderBy("sample").collect()]
    assert points == [(0, 0, 0), (1, 5, 0), (2, 10, 0), (3, 10, 5), (4, 10, 10), (5, 5, 10), (6, 0, 10), (7, 0, 5)]
    pair = make_layer([(0, 1, [square(0, 0, 10)])]).select("id", F.col("rings").alias("a")).join(
        make_layer([(0, 1, [square(13, 14, 5)])]).select("id", F.col("rings").alias("b")), "id")
    assert polygon_distance(pair, ["id"], "a", "b").first().distance == pytest.approx(5.0)
    same = pair.withColumn("b", F.col("a"))
    assert symmetric_boundary_distance(same, ["id"], "a", "b").first().boundary_distance == pytest.approx(0, abs=1e-12)


def test_arrow_kernels(make_layer):
    l_shape = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10), (0, 0)]
    layer = make_layer([(0, 1, [l_shape])])
    assert one(layer, A.hull_vertex_count("rings").alias("h")).h == 5
    steps = [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10), (0, 0)]
    simple = make_layer([(0, 1, [steps])]).select(A.simplify_rings(0.25)(F.col("rings")).alias("rings"))
    assert one(simple, G.vertex_count("rings").alias("v")).v == 4
    few = make_layer([(0, 1, [l_shape])]).select(A.editing_rings("rings", F.lit(64.0)).alias("rings"))
    assert one(few, G.vertex_count("rings").alias("v")).v == 5
    line = make_layer([(0, 1, [[(-5, 5), (15, 5), (15, 8), (-5, 8)]])]).select(
        A.clip_lines("rings", *[F.lit(float(v)) for v in (0, 0, 10, 10)]).alias("l")).first().l
    assert [[(p.x, p.y) for p in part] for part in line] == [[(0, 5), (10, 5)], [(10, 8), (0, 8)]]


def test_nearest_ends_with_unusable_geometry(spark):
    from parcelspark.operators.nearest import nearest_polygon

    nan = float("nan")
    shape = to_rings(square(0, 0, 10))
    source = [(1, 1, shape), (1, 2, None), (1, 3, []), (1, 4, to_rings([(nan, 0), (1, nan), (nan, nan), (nan, 0)])), (2, 5, shape), (3, 6, shape)]
    target = [(1, 7, to_rings(square(500, 0, 10))), (1, 8, None), (2, 9, None), (2, 10, [])]
    layer = f"project_id long, id long, rings {RINGS}"
    found = nearest_polygon(spark.createDataFrame(source, layer), spark.createDataFrame(target, layer), ["project_id"], 1.0).collect()
    assert [(r.source_id, r.target_id, r.distance) for r in found] == [(1, 7, pytest.approx(490.0))]
    none = spark.createDataFrame(target[1:2], layer)
    assert nearest_polygon(spark.createDataFrame(source, layer).drop("project_id"), none.drop("project_id"), [], 1.0).collect() == []
