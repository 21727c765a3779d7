"""Exact clipping into parts, and geometry of several parts."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from parcelspark.functions import geometry as G
from parcelspark.functions import multipart as M
from parcelspark.operators import pair_kernels as K
from parcelspark.operators.clipping import clip_parts, clip_to_box
from parcelspark.operators.flat import RingRows, parts_array, rings_array
from parcelspark.operators.shapes import _ARROW_RINGS
from parcelspark.operators.validity import with_validity
from parcelspark.sources.documents import read_multipart_lines
from parcelspark.sources.sinks import multipart_rows, write_features
from pyspark.sql import functions as F

from conftest import square, to_rings


def area(p):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:]))) / 2


def polygons(rows):
    return K.Polygons(rings_array(rows))


def box_ring(b):
    return np.array([(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])], float)


def clipped(rings, box):
    return clip_to_box([np.array(r, float) for r in rings], box)


U = [(0, 0), (30, 0), (30, 20), (20, 20), (20, 5), (10, 5), (10, 20), (0, 20), (0, 0)]


def test_a_concave_shape_falls_into_parts():
    parts = clipped([U], (-5, 10, 35, 30))
    assert [r[0].tolist() for r in parts] and [area(p[0]) for p in parts] == [100, 100]
    assert [p[0][:, 0].min() for p in parts] == [0, 20]
    assert [area(p[0]) for p in clipped([U[::-1]], (-5, 10, 25, 15))] == [50, 25]
    assert len(clipped([U], (-5, -5, 35, 30))) == 1  # all of it
    assert clipped([U], (11, 6, 19, 30)) == []  # between the arms
    assert clipped([U], (0, 20, 30, 40)) == []  # only touches
    assert [area(p[0]) for p in clipped([U], (0, 5, 30, 20))] == [150, 150]  # along the notch


def test_holes_are_kept_opened_or_taken_off():
    outer, hole = square(0, 0, 20), square(5, 5, 6)
    inside = clipped([outer, hole], (2, 2, 15, 15))
    assert len(inside) == 1 and len(inside[0]) == 2
    opened = clipped([outer, hole], (7, -5, 30, 30))
    assert len(opened) == 1 and len(opened[0]) == 1 and area(opened[0][0]) == 13 * 20 - 4 * 6
    through = clipped([outer, square(5, 0.5, 10, 19)], (-1, 3, 21, 10))
    assert [area(p[0]) for p in through] == [35, 35]
    assert clipped([outer, hole], (6, 6, 10, 10)) == []
    two = clipped([outer, square(2, 2, 3), square(10, 10, 3)], (1, 1, 19, 14))
    assert len(two) == 1 and len(two[0]) == 3


def star(rng, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(rng.uniform(2, 20) * math.cos(t), rng.uniform(2, 20) * math.sin(t)) for t in turns]
    return [*ring, ring[0]]


def test_parts_have_the_overlay_area_and_are_valid():
    rng = random.Random(5)
    shapes, boxes, made = [], [], []
    while len(shapes) < 400:
        # on whole numbers, positions and edges often lie on the sides of the box
        ring = [(round(x), round(y)) if len(shapes) % 2 else (x, y) for x, y in star(rng, rng.randrange(3, 25))]
        ring = [p for p, q in zip(ring, [None, *ring]) if p != q]
        if len(ring) < 4 or area(ring) == 0 or K.conflicts(polygons([[np.array(ring, float)]]))[0]:
            continue
        x, y = rng.randrange(-18, 10), rng.randrange(-18, 10)
        shapes.append([np.array(ring, float)])
        boxes.append((x, y, x + rng.randrange(1, 20), y + rng.randrange(1, 20)))
        made.append(clip_to_box(shapes[-1], boxes[-1]))
    whole = K.shared_areas(polygons(shapes), polygons([[box_ring(b)] for b in boxes]))
    for parts, box, want in zip(made, boxes, whole):
        total = sum(area(p[0]) - sum(area(h) for h in p[1:]) for p in parts)
        assert total == pytest.approx(want, abs=1e-9)
        for p in parts:
            assert p[0][:, 0].min() >= box[0] and p[0][:, 1].max() <= box[3]
        # parts of one shape share no area
        for i, p in enumerate(parts):
            for q in parts[i + 1:]:
                assert K.shared_areas(polygons([p]), polygons([q]))[0] == pytest.approx(0, abs=1e-9)
    assert sum(len(p) > 1 for p in made) > 10
    # half of the shapes are in general position: none of their parts crosses or touches itself
    parts = [p for m in made[::2] for p in m]
    assert not K.conflicts(polygons(parts)).any()


def test_clip_column(spark, make_layer):
    layer = make_layer([(0, 1, [U]), (0, 2, [square(100, 100, 5)])])
    rows = {r.id: r.p for r in layer.select("id", clip_parts("rings", *[F.lit(v) for v in (-5, 10, 35, 30)]).alias("p")).collect()}
    assert len(rows[1]) == 2 and rows[2] is None
    odd = spark.createDataFrame(
        [(1, None), (2, []), (3, [[]]), (4, to_rings([(0, 0), (1, float("nan")), (2, 0), (0, 0)]))], f"id long, rings {G.RINGS_TYPE}")
    assert [r.p for r in odd.select(clip_parts("rings", *[F.lit(v) for v in (0, 0, 9, 9)]).alias("p")).collect()] == [None] * 4


def test_flat_columns_return():
    rows = [[[np.array([(0.0, 1.0), (2.0, 3.0)])], [np.array([(5.0, 6.0)]), np.empty((0, 2))]], None, []]
    made = parts_array(rows)
    assert made.to_pylist() == [
        [[[{"x": 0, "y": 1}, {"x": 2, "y": 3}]], [[{"x": 5, "y": 6}], []]], None, []]
    back = RingRows(pa.array([[[{"x": 1, "y": 2}]], None, []], _ARROW_RINGS))
    assert back.polygon(0)[0].tolist() == [[1, 2]] and back.polygon(1) is None and back.polygon(2) == []


def test_multipart_documents(spark, tmp_path):
    one, two = to_rings(square(0, 0, 10), square(2, 2, 3)), to_rings(square(20, 0, 4))
    layer = spark.createDataFrame([(1, [one]), (2, [one, two]), (3, None)], f"id long, parts {M.PARTS_TYPE}")
    write_features(multipart_rows(layer.where("parts IS NOT NULL"), ["id"]), str(tmp_path / "out"))
    read = read_multipart_lines(spark, str(tmp_path / "out" / "features"))
    rows = {json.loads(r.properties)["id"]: r for r in read.collect()}
    assert rows[1].geometry_type == "Polygon" and rows[2].geometry_type == "MultiPolygon" and rows[2].feature_type == "Feature"
    sized = {r.id: (r.a, r.l) for r in layer.select("id", M.parts_area("parts").alias("a"), M.parts_perimeter("parts").alias("l")).collect()}
    assert sized == {1: (91, 52), 2: (107, 68), 3: (None, None)}
    parts = M.exploded_parts(layer, ["id"])
    assert sorted((r.id, r.part, r.is_valid) for r in with_validity(parts).collect()) == [(1, 0, True), (2, 0, True), (2, 1, True)]
    again = {r.id: r.parts for r in M.gathered_parts(parts.repartition(3), ["id"]).collect()}
    assert again == {r.id: r.parts for r in layer.collect() if r.parts}
    texts = spark.createDataFrame([(t,) for t in ('{"type":"Point","coordinates":[1,2]}', "{", None, '{"type":"MultiPolygon","coordinates":[]}')], "g string")
    assert [r.p for r in texts.select(M.parts_from_geojson("g").alias("p")).collect()] == [None, None, None, []]
