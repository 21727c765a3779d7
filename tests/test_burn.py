from pyspark.sql import functions as F

from conftest import RINGS, square, to_rings
from parcelspark.operators import burn as B

DIMS = "raster_id long, a double, b double, c double, d double, e double, f double, height int, width int"


def grid(spark, size=20):
    return spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, -1.0, float(size), size, size)], DIMS)


def layer(spark, *rows):
    return spark.createDataFrame([(1, i, k, i, to_rings(*r)) for i, (k, *r) in enumerate(rows)],
                                 f"raster_id long, id long, feature_type string, seq long, rings {RINGS}")


def brute_line(p, q, size=20, steps=20000):
    cells = set()
    for i in range(steps + 1):
        x = p[0] + (q[0] - p[0]) * i / steps
        y = p[1] + (q[1] - p[1]) * i / steps
        r, c = int((size - y) // 1), int(x // 1)
        if 0 <= r < size and 0 <= c < size:
            cells.add((r, c))
    return cells


def test_touched_pixels_of_a_slanted_line(spark):
    line = [(1.3, 2.2), (17.7, 11.9)]
    got = {(r.row, r.col) for r in B.touched_pixels(layer(spark, ("road", line)), grid(spark), ["raster_id", "id"]).collect()}
    assert got == brute_line(*line)
    outside = [(-5.5, 3.2), (30.1, 8.9)]
    got = {(r.row, r.col) for r in B.touched_pixels(layer(spark, ("road", outside)), grid(spark), ["raster_id", "id"]).collect()}
    assert got == brute_line(*outside)


def test_near_pixels_and_filled_polygons(spark):
    (x1, y1), (x2, y2) = line = [(3.3, 2.2), (15.7, 11.9)]

    def gap(px, py):
        t = max(0, min(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return ((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) ** 0.5

    got = {(r.row, r.col) for r in B.near_pixels(layer(spark, ("road", line)), grid(spark), ["raster_id", "id"], 3.0).collect()}
    assert got == {(r, c) for r in range(20) for c in range(20) if gap(c + 0.5, 20 - r - 0.5) <= 3}
    ringed = layer(spark, ("building", square(2, 2, 10), square(4, 4, 3)))
    got = {(r.row, r.col) for r in B.filled_pixels(ringed, grid(spark), ["raster_id", "id"]).collect()}
    inside = lambda v, lo, hi: lo <= v < hi
    assert got == {(r, c) for r in range(20) for c in range(20)
                   if inside(c, 2, 12) and inside(19 - r, 2, 12) and not (inside(c, 4, 7) and inside(19 - r, 4, 7))}


def test_later_feature_wins_and_band_is_cleared(spark):
    features = layer(spark, ("building", square(2.5, 2.5, 10)), ("road", [(0.5, 7.5), (19.5, 7.5)]))
    hard = B.hard_negative_pixels(features, grid(spark))
    codes = {(r.row, r.col): r.hard for r in hard.collect()}
    assert codes[(12, 5)] == 1 and codes[(16, 5)] == 2
    pixels = spark.createDataFrame([(1, r, c, -1.0 if c == 0 else 0.5) for r in range(20) for c in range(20)],
                                   "raster_id long, row long, col long, value double")
    edge = layer(spark, ("x", [(5.5, 0.0), (5.5, 20.0)]))
    line = B.touched_pixels(edge, grid(spark), ["raster_id", "id"])
    band = B.near_pixels(edge, grid(spark), ["raster_id", "id"], 4.0)
    rows = {(r.row, r.col): (r.label, r.hard) for r in B.label_pixels(pixels, line, hard, band).collect()}
    assert rows[(12, 5)] == (1, 0) and rows[(12, 0)] == (255, 0) and rows[(12, 15)] == (0, 1) and rows[(12, 8)] == (0, 0)
