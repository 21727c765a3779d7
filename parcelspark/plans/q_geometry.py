"""Registered queries: measures, overlays, topology, comparison, distances, windows."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import multipart as M
from ..functions import projection as P
from ..functions import scoring as S
from ..functions.once import computed_once
from ..operators import compare as C
from ..operators import readiness as Y
from ..operators import selection as L
from ..operators import shapes as A
from ..operators import topology as T
from ..operators.boundary import boundary_samples
from ..operators.clipping import clip_parts
from ..operators.nearest import nearest_polygon, neighbours_within
from ..operators.overlay import intersection_area
from ..operators.skew import shuffled
from ..operators.suppression import suppress_overlaps
from ..operators.validity import with_validity
from ..session import shared_folder
from ..sources import domain as D
from ..sources.documents import read_multipart_lines
from ..sources.sinks import multipart_rows, write_features
from .registry import query
from .vectorize import Config, stored_faces

R6 = lambda c: F.round(c, 6)
SCOPE = ["project_id"]


def _r(df, *names):
    return df.withColumns({n: R6(n) for n in names})


@query("G2 G5 G12 G13 G14 G15 F20", """
    SELECT l.id, round(a.area, 6) AS area, 2 * (w + h) + CASE WHEN l.id % 7 = 0 THEN 40 ELSE 0 END AS perimeter,
           x AS minx, y AS miny, x + w AS maxx, y + h AS maxy, CASE WHEN l.id % 5 = 0 THEN 6 ELSE 4 END AS vertices,
           CASE WHEN l.id % 5 = 0 THEN 6 ELSE 4 END + CASE WHEN l.id % 7 = 0 THEN 4 ELSE 0 END AS total_vertices,
           round(m.cx, 6) AS cx, round(m.cy, 6) AS cy,
           round(4 * pi() * a.area / (2 * (w + h) + CASE WHEN l.id % 7 = 0 THEN 40 ELSE 0 END) ** 2, 6) AS compactness
    FROM v_lattice l JOIN v_parcel_area a ON a.id = l.id JOIN v_moments m ON m.id = l.id""")
def parcel_measures(spark, sf):
    sized = computed_once(
        D.parcel_layer(spark, sf), area=G.polygon_area("rings"), perimeter=G.perimeter("rings"), c=G.centroid("rings"),
        vertices=G.vertex_count("rings"), total_vertices=G.total_vertex_count("rings"))
    boxed = G.with_bbox(sized).withColumn("compactness", G.compactness(F.col("area"), F.col("perimeter")))
    return boxed.select(
        "id", R6("area").alias("area"), R6("perimeter").alias("perimeter"), *["minx", "miny", "maxx", "maxy"], "vertices",
        "total_vertices", R6("c.x").alias("cx"), R6("c.y").alias("cy"), R6("compactness").alias("compactness"))


_LON = "radians({x1}*1e-5 - {x0}*1e-5)"
_Q = "(1 - {e2}) * (sin(radians({lat})) / (1 - {e2} * sin(radians({lat})) ** 2) + atanh({e} * sin(radians({lat}))) / {e})"


def _authalic(lat: str) -> str:
    return _Q.format(lat=lat, e2=repr(P._E2), e=repr(P._E))


_SOUTH = "(23.3 + (project_id % 100) * 0.02 + {y} * 1e-5)"


@query("G1 G3 G4 T8 K8", f"""
    SELECT b.id, round(sum(s * {P.WGS84_A!r}::DOUBLE ** 2 * radians((x1 - x0) * 1e-5) * ({_authalic(_SOUTH.format(y='y1'))} - {_authalic(_SOUTH.format(y='y0'))}) / 2), 2) AS geodesic_area,
           round(sum(s * {G.EARTH_RADIUS_M!r}::DOUBLE ** 2 * radians((x1 - x0) * 1e-5)
                 * (sin(radians({_SOUTH.format(y='y1')})) - sin(radians({_SOUTH.format(y='y0')})))), 2) AS spherical_area,
           any_value(per.p) AS perimeter
    FROM v_parcel_boxes b JOIN (
      SELECT id, round(sum(2 * {G.EARTH_RADIUS_M!r} * asin(least(1, sqrt(
               sin(radians((y2 - y1) * 1e-5) / 2) ** 2 + cos(radians({_SOUTH.format(y='y1')})) * cos(radians({_SOUTH.format(y='y2')}))
               * sin(radians((x2 - x1) * 1e-5) / 2) ** 2)))), 3) AS p
      FROM v_parcel_edges GROUP BY 1) per USING (id)
    GROUP BY 1""")
def lonlat_measures(spark, sf):
    return D.lonlat_layer(spark, sf).select(
        "id", F.round(P.geodesic_area("rings"), 2).alias("geodesic_area"),
        F.round(G.spherical_area("rings"), 2).alias("spherical_area"), F.round(G.haversine_perimeter("rings"), 3).alias("perimeter"))


def _utm_sql() -> str:
    scale = P.UTM_K0 * P._RECTIFYING
    xs = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(P._ALPHA, 1))
    ys = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(P._ALPHA, 1))
    return f"""
    SELECT id, round(500000 + {scale!r} * (eta + {xs}), 3) AS easting, round({scale!r} * (xi + {ys}), 3) AS northing, true AS returns
    FROM (SELECT id, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) ** 2)) AS eta
          FROM (SELECT id, dl, sinh(atanh(s) - {P._E!r} * atanh({P._E!r} * s)) AS t
                FROM (SELECT id, radians(85.3 + x * 1e-5 - 87.0) AS dl, sin(radians({_SOUTH.format(y='y')})) AS s FROM v_lattice)))"""


@query("G24 G25 S6", _utm_sql())
def utm_positions(spark, sf):
    metric = computed_once(D.lonlat_layer(spark, sf), rings=P.to_utm("rings", 45))
    first = F.col("rings")[0][0]
    return metric.select(
        "id", F.round(first["x"], 3).alias("easting"), F.round(first["y"], 3).alias("northing"),
        (P.round_trip_shift("rings", 45) < 1e-6).alias("returns"))


@query("J5 J3 K1 K3 G6", "SELECT project_id, l_id, r_id, round(inter_area, 6) AS inter_area FROM v_overlap_pairs WHERE inter_area > 1.0")
def overlap_pairs(spark, sf):
    return _r(T.overlap_pairs(D.parcel_layer(spark, sf), SCOPE), "inter_area")


@query("J6 A13", """
    SELECT p.project_id, count(o.l_id) AS overlap_pairs, round(coalesce(sum(o.inter_area), 0), 6) AS overlap_area
    FROM v_projects p LEFT JOIN v_overlap_pairs o ON o.project_id = p.project_id AND inter_area > 0.01 GROUP BY 1""")
def overlap_totals(spark, sf):
    return _r(T.overlap_totals(D.parcel_layer(spark, sf), SCOPE), "overlap_area")


@query("J3 J4", "SELECT project_id, id, topology_violation FROM v_topology")
def topology_violations_by_parcel(spark, sf):
    return T.topology_violation(D.parcel_layer(spark, sf), SCOPE)


def _with_faults(spark, sf):
    """The parcel layer with a crossed boundary for every 11th parcel and a sliver beside the layer for every 13th."""
    k, x, y = F.col("id"), F.col("rings")[0][0]["x"], F.col("rings")[0][0]["y"]
    bow = F.array(G.ring([(x, y), (x + 9, y + 7), (x + 9, y), (x, y + 9), (x, y)]))
    thin = G.box_polygon(x + 10_000, y, x + 10_005, y + 5)
    return computed_once(D.parcel_layer(spark, sf), rings=F.when(k % 11 == 0, bow).when(k % 13 == 0, thin).otherwise(F.col("rings")))


@query("A12 U5 G11", """
    SELECT p.project_id, p.invalid_geometry, p.sliver, count(o.l_id) AS overlap, p.invalid_geometry + p.sliver + count(o.l_id) = 0 AS valid
    FROM (SELECT project_id, count(*) FILTER (WHERE id % 11 = 0) AS invalid_geometry, count(*) FILTER (WHERE id % 13 = 0 AND id % 11 <> 0) AS sliver
          FROM v_lattice GROUP BY 1) p
    LEFT JOIN v_overlap_pairs o ON o.project_id = p.project_id AND inter_area > 1.0
      AND l_id % 11 <> 0 AND l_id % 13 <> 0 AND r_id % 11 <> 0 AND r_id % 13 <> 0 GROUP BY 1, 2, 3""")
def topology_report(spark, sf):
    return T.topology_report(_with_faults(spark, sf), SCOPE)


@query("A12 U5 A13", """
    SELECT project_id, id, 'invalid_geometry' AS type FROM v_lattice WHERE id % 11 = 0
    UNION ALL SELECT project_id, id, 'sliver' FROM v_lattice WHERE id % 13 = 0 AND id % 11 <> 0
    UNION ALL SELECT project_id, l_id, 'overlap' FROM v_overlap_pairs
    WHERE inter_area > 1.0 AND l_id % 11 <> 0 AND l_id % 13 <> 0 AND r_id % 11 <> 0 AND r_id % 13 <> 0""")
def topology_findings(spark, sf):
    return T.topology_violations(_with_faults(spark, sf), SCOPE).select("project_id", "id", "type")


@query("A12 A26", """
    SELECT a.project_id, a.id, round(a.area, 6) AS area, round(m.m, 6) AS median_area
    FROM v_parcel_area a JOIN (SELECT project_id, quantile_cont(area, 0.5) AS m FROM v_parcel_area GROUP BY 1) m USING (project_id)
    WHERE a.area < m.m * 0.85""")
def small_parcels(spark, sf):
    return _r(T.slivers(D.parcel_layer(spark, sf), SCOPE, 0.85), "area", "median_area")


@query("A13 U5", """
    SELECT 'before' AS phase, 'overlap' AS type, count(*) AS violations FROM v_overlap_pairs WHERE inter_area > 1.0
    UNION ALL
    SELECT 'after', 'overlap', count(*) FROM v_ref_boxes a JOIN v_ref_boxes b ON a.project_id = b.project_id AND a.id < b.id
    WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1.0
    HAVING count(*) > 0""")
def violations_before_and_after(spark, sf):
    before = T.violation_counts(D.parcel_layer(spark, sf), SCOPE).select(F.lit("before").alias("phase"), "type", "violations")
    return before.unionByName(T.violation_counts(D.reference_layer(spark, sf), SCOPE).select(F.lit("after").alias("phase"), "type", "violations"))


@query("G11 V4 V24", "SELECT project_id, id, CASE WHEN id % 11 = 0 THEN 'self_intersection' WHEN id % 13 = 0 THEN 'not_closed' END AS invalid_reason FROM v_lattice")
def validity_reasons(spark, sf):
    layer = D.parcel_layer(spark, sf)
    x, y = F.col("rings")[0][0]["x"], F.col("rings")[0][0]["y"]
    bow = F.array(G.ring([(x, y), (x + 9, y + 7), (x + 9, y), (x, y + 9), (x, y)]))
    broken = F.when(F.col("id") % 11 == 0, bow).when(
        F.col("id") % 13 == 0, F.array(F.slice(F.col("rings")[0], 1, F.size(F.col("rings")[0]) - 1))).otherwise(F.col("rings"))
    return with_validity(computed_once(layer, rings=broken)).select("project_id", "id", "invalid_reason")


@query("J7 K2 G7", """
    SELECT p.project_id, p.id, round(coalesce(max(iou), 0), 6) AS best_iou FROM v_lattice p LEFT JOIN v_iou ON a_id = p.id GROUP BY 1, 2""")
def best_iou(spark, sf):
    return _r(C.best_iou(D.parcel_layer(spark, sf), D.reference_layer(spark, sf), SCOPE), "best_iou")


_COMPARE = """
    SELECT *, round(2 * p * r / (p + r), 6) AS harmonic_mean_best_iou FROM (
      SELECT c.project_id, count(*) AS candidate_count, avg(c.best) AS p FROM (
        SELECT project_id, a_id, max(iou) AS best FROM v_iou GROUP BY 1, 2) c GROUP BY 1)
    JOIN (SELECT project_id, count(*) AS reference_count, avg(best) AS r, count(*) FILTER (WHERE best >= 0.5) AS m50,
                 count(*) FILTER (WHERE best >= 0.75) AS m75
          FROM (SELECT project_id, b_id, max(iou) AS best FROM v_iou GROUP BY 1, 2) GROUP BY 1) USING (project_id)
    JOIN (SELECT project_id, quantile_cont(area, 0.5) AS ma FROM v_parcel_area GROUP BY 1) USING (project_id)
    JOIN (SELECT project_id, quantile_cont(area, 0.5) AS mr FROM v_ref_area GROUP BY 1) USING (project_id)"""


@query("A10 J7 J9", f"""
    SELECT project_id, candidate_count, reference_count, 0 AS invalid_candidates, round(p, 6) AS candidate_mean_best_iou,
           round(r, 6) AS reference_mean_best_iou, harmonic_mean_best_iou, m50 AS reference_matched_iou_50, m75 AS reference_matched_iou_75,
           round(d, 6) AS mean_symmetric_boundary_distance_m, round(ma, 6) AS median_candidate_area_m2, round(mr, 6) AS median_reference_area_m2
    FROM ({_COMPARE}) JOIN (SELECT project_id, avg(boundary_distance) AS d FROM v_boundary_distance
                            JOIN v_lattice ON id = source_id GROUP BY 1) USING (project_id)""")
def layer_comparison(spark, sf):
    rows = C.compare_layers(D.parcel_layer(spark, sf), D.reference_layer(spark, sf), SCOPE, radius=8.0)
    return _r(rows, "candidate_mean_best_iou", "reference_mean_best_iou", "harmonic_mean_best_iou",
              "mean_symmetric_boundary_distance_m", "median_candidate_area_m2", "median_reference_area_m2")


@query("J8 K7 G18", "SELECT project_id, source_id, target_id, round(distance, 6) AS distance FROM v_nearest")
def nearest_reference(spark, sf):
    return _r(nearest_polygon(D.parcel_layer(spark, sf), D.reference_layer(spark, sf), SCOPE, 8.0), "distance")


@query("J9 K6 G17 W12", "SELECT source_id, target_id, round(boundary_distance, 6) AS boundary_distance FROM v_boundary_distance")
def boundary_distances(spark, sf):
    rows = C.boundary_distances(D.parcel_layer(spark, sf), D.reference_layer(spark, sf), SCOPE, 8.0)
    return _r(rows, "boundary_distance").drop("project_id")


@query("G17 K6 W12 G23", """
    SELECT id, sample, round(sx, 6) AS sx, round(sy, 6) AS sy FROM v_samples WHERE layer = 'a'""")
def boundary_points(spark, sf):
    return _r(boundary_samples(D.parcel_layer(spark, sf), ["id"], "rings", 96), "sx", "sy")


@query("J10 G18", """
    SELECT e.project_id, e.id AS l_id, g.id AS r_id, round(CASE WHEN any_value(o.inter_area) > 1e-9 THEN 0 ELSE min(sqrt(
             greatest(0, least(e.x1, e.x2) - greatest(g.x1, g.x2), least(g.x1, g.x2) - greatest(e.x1, e.x2)) ** 2 +
             greatest(0, least(e.y1, e.y2) - greatest(g.y1, g.y2), least(g.y1, g.y2) - greatest(e.y1, e.y2)) ** 2)) END, 6) AS distance
    FROM v_parcel_edges e JOIN v_parcel_edges g ON e.project_id = g.project_id AND e.id < g.id
    JOIN v_overlap_pairs o ON o.l_id = e.id AND o.r_id = g.id
    GROUP BY 1, 2, 3 HAVING distance < 5""")
def close_neighbours(spark, sf):
    return _r(neighbours_within(D.parcel_layer(spark, sf), SCOPE, 5.0), "distance")


@query("W6 O8 K9", """
    WITH RECURSIVE ranked AS (
      SELECT project_id, id, area, row_number() OVER (PARTITION BY project_id ORDER BY area DESC, id) AS rk FROM v_parcel_area),
    conflicts AS (
      SELECT id, list(other) AS others FROM (
        SELECT l_id AS id, r_id AS other FROM v_overlap_pairs WHERE inter_area > 0.01
        UNION ALL SELECT r_id, l_id FROM v_overlap_pairs WHERE inter_area > 0.01) GROUP BY 1),
    step AS (
      SELECT project_id, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM v_projects
      UNION ALL
      SELECT s.project_id, r.rk, CASE WHEN list_has_any(coalesce(c.others, []), s.kept) THEN s.kept ELSE list_append(s.kept, r.id) END
      FROM step s JOIN ranked r ON r.project_id = s.project_id AND r.rk = s.rk + 1 LEFT JOIN conflicts c ON c.id = r.id)
    SELECT k.project_id, k.id, round(a.area, 6) AS area FROM (
      SELECT project_id, UNNEST(kept) AS id FROM step QUALIFY rk = max(rk) OVER (PARTITION BY project_id)) k
    JOIN v_parcel_area a ON a.id = k.id""")
def suppressed_layer(spark, sf):
    return _r(suppress_overlaps(D.parcel_layer(spark, sf), SCOPE), "area")


@query("G19 G30 G31 G29 F11 F10", """
    SELECT l.id, CASE WHEN l.id % 5 = 0 THEN 5 ELSE 4 END AS hull_vertices, round(coalesce(o.t, 0) / a.area, 6) AS topology_penalty,
           round(0.5 * (1 - 4 * pi() * (w * h - CASE WHEN l.id % 5 = 0 THEN 300 ELSE 0 END) / (2 * (w + h)) ** 2)
                 + CASE WHEN l.id % 5 = 0 THEN 0.5 * (6 - 5) / 5.0 ELSE 0 END, 6) AS regularity_penalty,
           round(sqrt(((l.id * 13) % 9 - 4) ** 2 + ((l.id * 17) % 9 - 4) ** 2) / sqrt(w * h / pi()), 6) AS deviation_penalty
    FROM v_lattice l JOIN v_parcel_area a ON a.id = l.id LEFT JOIN (
      SELECT id, sum(inter_area) AS t FROM (SELECT l_id AS id, inter_area FROM v_overlap_pairs UNION ALL SELECT r_id, inter_area FROM v_overlap_pairs)
      GROUP BY 1) o ON o.id = l.id""")
def shape_penalties(spark, sf):
    layer = D.parcel_layer(spark, sf)
    pairs = T.overlap_pairs(layer, SCOPE, 0.0)
    lapped = pairs.select(F.explode(F.array("l_id", "r_id")).alias("id"), "inter_area").groupBy("id").agg(F.sum("inter_area").alias("_t"))
    outer = F.slice("rings", 1, 1)
    x, y, w, h = D._lattice(F.col("id"))
    before = F.slice(G.box_ring(x, y, x + w, y + h), 1, 4)
    moved = F.slice(D.reference_rings(F.col("id"))[0], 1, 4)
    sized = computed_once(
        layer, area=G.polygon_area("rings"), _outer=G.polygon_area(outer), _length=G.perimeter(outer),
        vertices=G.vertex_count("rings"), hull_vertices=A.hull_vertex_count("rings"),
        deviation_penalty=G.deviation_term(moved, before, w * h))
    joined = sized.join(shuffled(lapped), "id", "left")
    penalty = S.regularity_penalty(
        G.compactness(F.col("_outer"), F.col("_length")), F.col("vertices"), F.col("hull_vertices"), F.col("area") <= 0)
    return joined.select(
        "id", "hull_vertices", R6(F.coalesce("_t", F.lit(0.0)) / F.col("area")).alias("topology_penalty"),
        R6(penalty).alias("regularity_penalty"), R6("deviation_penalty").alias("deviation_penalty"))


@query("G20 G16 V28", """
    SELECT id, round(sum(s * greatest(0, least(x1, 400.5) - greatest(x0, 30.5)) * greatest(0, least(y1, 200.5) - greatest(y0, 30.5))), 6) AS clipped_area
    FROM v_parcel_boxes GROUP BY 1 HAVING clipped_area > 0""")
def clipped_parcels(spark, sf):
    box = [F.lit(v) for v in (30.5, 30.5, 400.5, 200.5)]
    cut = computed_once(D.parcel_layer(spark, sf).select("id", "rings"), parts=clip_parts("rings", *box)).where(F.col("parts").isNotNull())
    return cut.select("id", R6(M.parts_area("parts")).alias("clipped_area"))


@query("G20 G28 G11", """
    SELECT id, part::INTEGER AS part, n AS parts, round((CASE WHEN part = n - 1 THEN u - 3 ELSE u END) * (h - 20), 6) AS part_area,
           round((n * u - 3) * (h - 20), 6) AS clipped_area, true AS valid
    FROM (SELECT id, h, n, w / (2 * n - 1) AS u, unnest(range(0, n)) AS part FROM (SELECT *, (2 + id % 4)::INTEGER AS n FROM v_lattice))""")
def comb_parts(spark, sf):
    """Combs of two to five teeth, cut above their base: every tooth is a part of its own."""
    combs = computed_once(D.parcel_layer(spark, sf).select("id"), rings=D.comb_rings(F.col("id")))
    x, y, w, h = D._lattice(F.col("id"))
    cut = computed_once(combs, parts=clip_parts("rings", x - 5, y + 20, x + w - 3, y + h + 5))
    rows = M.exploded_parts(cut.select("id", F.size("parts").alias("parts"), M.parts_area("parts").alias("clipped_area"), F.col("parts").alias("_p")),
                            ["id", "parts", "clipped_area"], "_p")
    checked = with_validity(rows)
    return checked.select("id", "part", "parts", R6(G.polygon_area("rings")).alias("part_area"), R6("clipped_area").alias("clipped_area"), F.col("is_valid").alias("valid"))


@query("G20 J20 G23", """
    SELECT b.id, image, round(sum(s * greatest(0, least(b.x1, i.x1) - greatest(b.x0, i.x0)) * greatest(0, least(b.y1, i.y1) - greatest(b.y0, i.y0))), 6) AS crop_area
    FROM v_parcel_boxes b, (SELECT c * 3 + r AS image, c * 210.0 AS x0, r * 130.0 AS y0, c * 210.0 + 230 AS x1, r * 130.0 + 150 AS y1
                            FROM range(0, 3) cs(c), range(0, 3) rs(r)) i
    GROUP BY 1, 2 HAVING crop_area > 0""")
def label_crops(spark, sf):
    """Every label cut to every crop of a project's image that it reaches; empty and broken crops are left out."""
    column, row = F.floor(F.col("id") / 3), F.col("id") % 3
    x, y = column * 210.0, row * 130.0
    images = G.with_bbox(computed_once(spark.range(9), rings=G.box_polygon(x, y, x + 230, y + 150)))
    labels = G.with_bbox(D.parcel_layer(spark, sf).select("id", "rings"))
    crops = Y.cropped_labels(labels, images)
    return crops.select("id", "image", R6(M.parts_area("parts")).alias("crop_area"))


@query("R9 G25 G24", """
    SELECT id, CASE WHEN id % 13 = 0 THEN 4 WHEN id % 5 = 0 THEN 6 ELSE 4 END AS vertices, 0.4::DOUBLE AS threshold, 3 AS close_pixels, true AS placed
    FROM v_lattice WHERE id % 11 <> 0""")
def stored_candidates(spark, sf):
    """Candidates brought to storage axes: crossed boundaries are dropped, the others carry their settings."""
    layer = computed_once(_with_faults(spark, sf), rings=G.map_points("rings", lambda x, y: G.point(x + 400_000, y + 2_500_000)))
    rows = stored_faces(layer, 45, Config(threshold=0.4, close_pixels=3))
    lon, lat = F.col("rings")[0][0]["x"], F.col("rings")[0][0]["y"]
    return rows.select("id", G.vertex_count("rings").alias("vertices"), "configuration.threshold", "configuration.close_pixels",
                       (lon.between(85, 87) & lat.between(22, 23)).alias("placed"))


@query("G28 G33 S6 S9 V3", """
    SELECT a.id, CASE WHEN a.id % 4 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type, CASE WHEN a.id % 4 = 0 THEN 2 ELSE 1 END AS parts,
           round(a.area + CASE WHEN a.id % 4 = 0 THEN 16 ELSE 0 END, 6) AS area, true AS valid, true AS returns
    FROM v_parcel_area a""")
def multipart_features(spark, sf):
    """Parcels with an island as MultiPolygon features: written, read again, taken apart, checked and put together."""
    x, y, w, h = D._lattice(F.col("id"))
    island = F.array(G.box_ring(x + w + 1, y + h + 1, x + w + 5, y + h + 5))
    layer = computed_once(D.parcel_layer(spark, sf), parts=F.when(F.col("id") % 4 == 0, F.array("rings", island)).otherwise(M.one_part("rings")))
    path = shared_folder(spark, "multipart-features")
    write_features(multipart_rows(layer, ["id"]), path)
    read = read_multipart_lines(spark, f"{path}/features").select(
        F.get_json_object("properties", "$.id").cast("long").alias("id"), "geometry_type", "parts")
    parts = with_validity(M.exploded_parts(read, ["id"]))
    lapping = T.overlap_totals(parts.select(F.col("id").alias("feature"), F.col("part").alias("id"), "rings"), ["feature"])
    judged = parts.groupBy("id").agg(F.bool_and("is_valid").alias("_valid")).join(
        lapping.select(F.col("feature").alias("id"), (F.col("overlap_pairs") == 0).alias("_apart")), "id")
    again = M.gathered_parts(parts, ["id"]).select("id", F.col("parts").alias("_again"))
    rows = read.join(judged, "id").join(again, "id").join(layer.select("id", F.col("parts").alias("_first")), "id")
    return rows.select(
        "id", "geometry_type", F.size("parts").alias("parts"), R6(M.parts_area("parts")).alias("area"),
        (F.col("_valid") & F.col("_apart")).alias("valid"), (F.col("_again") == F.col("_first")).alias("returns"))


@query("G22 G14", """
    SELECT id, CASE WHEN id % 5 = 0 THEN 5 ELSE 4 END + CASE WHEN id % 7 = 0 THEN 4 ELSE 0 END AS handles FROM v_lattice""")
def editing_handles(spark, sf):
    few = D.lonlat_layer(spark, sf).select("id", A.editing_rings("rings", G.spherical_ring_area(G.exterior("rings"))).alias("rings"))
    return few.select("id", G.total_vertex_count("rings").alias("handles"))


@query("G21", "SELECT id, CASE WHEN id % 5 = 0 THEN 6 ELSE 4 END AS vertices FROM v_lattice")
def simplified_parcels(spark, sf):
    from ..operators.raster import simplify_faces

    def midpoint(e):
        return F.struct(((e["x1"] + e["x2"]) / 2 + 0.1).alias("x"), ((e["y1"] + e["y2"]) / 2 + 0.1).alias("y"))

    start = lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y"))
    dense = F.transform("rings", lambda r: F.concat(
        F.flatten(F.transform(G.ring_edges(r), lambda e: F.array(start(e), midpoint(e)))), F.slice(r, 1, 1)))
    layer = computed_once(D.parcel_layer(spark, sf), rings=dense)
    return simplify_faces(layer, 0.25).select("id", G.vertex_count("rings").alias("vertices"))


@query("G10 G27 G33 V3", """
    SELECT id, id % 3 <> 0 AS equal, CASE WHEN id % 5 = 0 THEN 6 ELSE 4 END AS open_positions, true AS text_returns,
           'POLYGON ((' || printf('%.1f %.1f', x, y) AS text_head
    FROM v_lattice""")
def geometry_text(spark, sf):
    moved = F.when(F.col("id") % 3 == 0, 1e-6).otherwise(1e-13)
    both = computed_once(D.parcel_layer(spark, sf), other=G.map_points("rings", lambda x, y: G.point(x + moved, y)), wkt=G.to_wkt("rings"))
    return both.select(
        "id", G.equals_exact("rings", "other").alias("equal"), F.size(G.open_ring(G.exterior("rings"))).alias("open_positions"),
        G.equals_exact("rings", G.from_wkt("wkt"), 0.0).alias("text_returns"), F.substring_index("wkt", ",", 1).alias("text_head"))


@query("G9 G6", """
    SELECT a.id, round(sum(greatest(0, least(x1, 400) - greatest(x0, 0)) * greatest(0, least(y1, 200) - greatest(y0, 0)) * s), 6) AS inside_area,
           bool_and(x0 >= 0 AND x1 <= 400 AND y0 >= 0 AND y1 <= 200) AS contained
    FROM v_parcel_boxes a GROUP BY 1""")
def area_in_box(spark, sf):
    boxed = G.with_bbox(D.parcel_layer(spark, sf)).withColumn(
        "frame", G.box_polygon(F.lit(0), F.lit(0), F.lit(400), F.lit(200)))
    inside = (F.col("minx") >= 0) & (F.col("maxx") <= 400) & (F.col("miny") >= 0) & (F.col("maxy") <= 200)
    rows = intersection_area(boxed.withColumn("contained", inside), ["id"], "rings", "frame", carry=["contained"], out="inside_area")
    return _r(rows, "inside_area")


# --- windows, splits, AOI ----------------------------------------------------

_SPLIT = "CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"


def _windows(spark, sf):
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("id") % 3 + 1).cast("int"))
    return G.with_bbox(D.parcel_layer(spark, sf)).withColumn("split", split)


@query("J17", f"""
    SELECT a.project_id, a.id AS l_id, b.id AS r_id, a.split AS l_split, b.split AS r_split
    FROM (SELECT *, {_SPLIT} AS split FROM v_lattice) a JOIN (SELECT *, {_SPLIT} AS split FROM v_lattice) b
      ON a.project_id = b.project_id AND a.id < b.id AND a.split <> b.split
     AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h""")
def split_leakage(spark, sf):
    return Y.split_leakage(_windows(spark, sf), SCOPE)


@query("J18", """
    SELECT id FROM v_lattice p WHERE NOT EXISTS (
      SELECT 1 FROM v_lattice t WHERE t.id % 17 = 0 AND t.x <= p.x + p.w AND p.x <= t.x + t.w AND t.y <= p.y + p.h AND p.y <= t.y + t.h)""")
def windows_outside_target(spark, sf):
    boxed = G.with_bbox(D.parcel_layer(spark, sf).select("id", "rings"))
    return Y.outside_target(boxed, boxed.where(F.col("id") % 17 == 0)).select("id")


# four images a project, of its lower and middle rows of parcels; the upper ones lie in none
_IMAGES = """(SELECT o_custkey * 1000000 + k AS image, o_custkey AS project_id, k * 150.0 AS x0, 0.0 AS y0, k * 150.0 + 90 AS x1, 180.0 AS y1
              FROM (SELECT DISTINCT CAST(floor(c_custkey / 60) AS BIGINT) AS o_custkey FROM customer), range(0, 4) t(k))"""


def _images(spark, sf):
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = D.parcel_layer(spark, sf).select("project_id").distinct().select("project_id", k.alias("_k"))
    x = F.col("_k") * 150.0
    return G.with_bbox(computed_once(
        rows.select("project_id", (F.col("project_id") * 1000000 + F.col("_k")).alias("id"), "_k"), rings=G.box_polygon(x, F.lit(0), x + 90, F.lit(180))))


# 60 overlapping images over the whole lattice, which all projects share
_IMAGE_GRID = "(SELECT r AS image, (r % 10) * 55.0 AS x0, (r // 10) * 50.0 AS y0, (r % 10) * 55.0 + 90 AS x1, (r // 10) * 50.0 + 80 AS y1 FROM range(0, 60) t(r))"


def _image_grid(spark):
    x, y = (F.col("id") % 10) * 55.0, F.floor(F.col("id") / 10) * 50.0
    return G.with_bbox(computed_once(spark.range(60), rings=G.box_polygon(x, y, x + 90, y + 80)))


@query("J20 J18", f"""
    SELECT b.id, min(i.image) AS image_index FROM (
      SELECT b.id, i.image, sum(b.s * greatest(0, least(b.x1, i.x1) - greatest(b.x0, i.x0)) * greatest(0, least(b.y1, i.y1) - greatest(b.y0, i.y0))) AS a
      FROM v_parcel_boxes b, {_IMAGE_GRID} i GROUP BY 1, 2) b JOIN {_IMAGE_GRID} i ON i.image = b.image WHERE b.a > 1e-9 GROUP BY 1""")
def first_matching_image(spark, sf):
    features = G.with_bbox(D.parcel_layer(spark, sf).select("id", "rings"))
    return Y.first_image(features, _image_grid(spark))


@query("J19", f"""
    SELECT id AS parcel_id FROM v_lattice WHERE id NOT IN (
      SELECT b.id FROM v_parcel_boxes b JOIN {_IMAGES} i USING (project_id) GROUP BY b.id, i.image
      HAVING sum(b.s * greatest(0, least(b.x1, i.x1) - greatest(b.x0, i.x0)) * greatest(0, least(b.y1, i.y1) - greatest(b.y0, i.y0))) > 1e-9)""")
def unmatched_reviewed(spark, sf):
    from ..operators.review import unmatched_ids

    layer = D.parcel_layer(spark, sf).select(*SCOPE, "id", "rings")
    matched = Y.first_image(G.with_bbox(layer), _images(spark, sf), SCOPE).select(F.col("id").alias("parcel_id"))
    return unmatched_ids(layer.select(F.col("id").alias("parcel_id")), matched)


@query("A27 G15", """
    SELECT project_id, min(x) - 25 AS minx, min(y) - 25 AS miny, max(x + w) + 25 AS maxx, max(y + h) + 25 AS maxy FROM v_lattice GROUP BY 1""")
def layer_extent(spark, sf):
    return Y.extent(D.parcel_layer(spark, sf), SCOPE)


@query("A28 G5", "SELECT project_id, round(sum(abs(x2 - x1) + abs(y2 - y1)), 6) AS line_length_m FROM v_parcel_edges GROUP BY 1")
def line_length(spark, sf):
    sized = computed_once(D.parcel_layer(spark, sf), length_m=G.perimeter("rings"))
    return sized.groupBy("project_id").agg(R6(F.sum("length_m")).alias("line_length_m"))


@query("V28 V26", """
    SELECT project_id, count(*) AS reference_count, round(sum(2 * ((x1 - x0) + (y1 - y0))), 6) AS line_length_m FROM v_ref_boxes
    WHERE x0 >= 0 AND y0 >= 0 AND x1 <= 560 AND y1 <= 300 AND (x1 - x0) * (y1 - y0) > 20 AND (x1 - x0) * (y1 - y0) < 3600
    GROUP BY 1 HAVING count(*) >= 2 AND line_length_m >= 200""")
def suitable_windows(spark, sf):
    ref = D.reference_layer(spark, sf)
    frame = D.projects(spark, sf).select("project_id", F.lit(-5.0).alias("minx"), F.lit(-5.0).alias("miny"),
                                         F.lit(565.0).alias("maxx"), F.lit(305.0).alias("maxy"))
    faces = Y.reference_faces(ref, frame, SCOPE, max_area=3600.0)
    lines = computed_once(faces, length_m=G.perimeter("rings")).select("project_id", "length_m")
    return _r(Y.suitable_windows(faces, lines, SCOPE), "line_length_m")


_PICKS = """
    SELECT pick, id, rank, split, name FROM (
      SELECT id, row_number() OVER (ORDER BY w * h, id) - 1 AS rank, count(*) OVER () AS n FROM v_lattice)
    JOIN (SELECT * FROM (VALUES {values}) t(pick, split, name)) ON rank = round_even(pick * (n - 1) / 14.0, 0)"""


@query("W7 W8", _PICKS.format(values=", ".join(
    f"({i}, '{s}', '{n}')" for i, (s, n) in enumerate(L.split_schedule(9, 3, 3)))))
def stratified_splits(spark, sf):
    x, y, w, h = D._lattice(F.col("id"))
    windows = D.parcel_layer(spark, sf).select("id", (w * h).alias("length"))
    picked = L.stratified_windows(windows, ["length", "id"], 15)
    return L.assign_splits(picked, 9, 3, 3).select("pick", "id", "rank", "split", "name")


@query("W9 G12", """
    WITH cells AS (SELECT l.project_id, l.id, CAST(floor(m.cx / 100) AS BIGINT) AS cell_x, CAST(floor(m.cy / 100) AS BIGINT) AS cell_y
                   FROM v_lattice l JOIN v_moments m USING (id))
    SELECT c.project_id, c.id, cell_x, cell_y, g.group_index FROM cells c JOIN (
      SELECT project_id, cell_x, cell_y, row_number() OVER (PARTITION BY project_id ORDER BY min(id)) - 1 AS group_index
      FROM cells GROUP BY 1, 2, 3) g USING (project_id, cell_x, cell_y)""")
def location_cells(spark, sf):
    centred = computed_once(D.parcel_layer(spark, sf), c=G.centroid("rings"))
    features = centred.select("project_id", F.col("id"), F.col("id").alias("seq"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    return L.location_cells(features, SCOPE, 100.0).select("project_id", "id", "cell_x", "cell_y", "group_index")


# --- features as pixels ------------------------------------------------------

_GRID = """
    SELECT project_id, r AS row, c AS col, -10.3 + c * 5 AS px0, -10.3 + c * 5 + 5 AS px1, 400.7 - r * 5 - 5 AS py0, 400.7 - r * 5 AS py1
    FROM v_projects, range(0, 84) a(r), range(0, 126) b(c)"""


def _grids(spark, sf):
    return D.projects(spark, sf).select(
        F.col("project_id").alias("raster_id"), F.lit(5.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-10.3).alias("c"), F.lit(0.0).alias("d"),
        F.lit(-5.0).alias("e"), F.lit(400.7).alias("f"), F.lit(84).alias("height"), F.lit(126).alias("width"))


def _features(spark, sf):
    return D.parcel_layer(spark, sf).withColumnRenamed("project_id", "raster_id")


@query("G35 G23 G26", f"""
    SELECT DISTINCT g.project_id AS raster_id, g.row, g.col FROM ({_GRID}) g JOIN v_parcel_edges e ON e.project_id = g.project_id
      AND least(e.x1, e.x2) <= g.px1 AND greatest(e.x1, e.x2) >= g.px0 AND least(e.y1, e.y2) <= g.py1 AND greatest(e.y1, e.y2) >= g.py0""")
def burned_lines(spark, sf):
    from ..operators.burn import touched_pixels

    return touched_pixels(_features(spark, sf), _grids(spark, sf), ["raster_id", "id"]).select("raster_id", "row", "col").distinct()


@query("G34", f"""
    SELECT DISTINCT g.project_id AS raster_id, g.row, g.col FROM (SELECT *, (px0 + px1) / 2 AS px, (py0 + py1) / 2 AS py FROM ({_GRID})) g
    JOIN v_parcel_edges e ON e.project_id = g.project_id
      AND greatest(0, least(e.x1, e.x2) - px, px - greatest(e.x1, e.x2)) ** 2 + greatest(0, least(e.y1, e.y2) - py, py - greatest(e.y1, e.y2)) ** 2 <= 9.0""")
def protected_band(spark, sf):
    from ..operators.burn import near_pixels

    return near_pixels(_features(spark, sf), _grids(spark, sf), ["raster_id", "id"], 3.0).select("raster_id", "row", "col").distinct()


@query("G34", f"""
    SELECT b.id, count(*) AS pixels FROM (
      SELECT b.id, g.row, g.col, sum(b.s) AS s FROM (SELECT *, (px0 + px1) / 2 AS px, (py0 + py1) / 2 AS py FROM ({_GRID})) g
      JOIN v_parcel_boxes b ON b.project_id = g.project_id AND px BETWEEN b.x0 AND b.x1 AND py BETWEEN b.y0 AND b.y1 GROUP BY 1, 2, 3) b
    WHERE s > 0 GROUP BY 1""")
def filled_parcels(spark, sf):
    from ..operators.burn import filled_pixels

    return filled_pixels(_features(spark, sf), _grids(spark, sf), ["raster_id", "id"]).groupBy("id").agg(
        F.count(F.lit(1)).alias("pixels"))
