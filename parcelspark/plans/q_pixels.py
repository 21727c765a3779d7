"""Registered queries: pixel metrics, readiness, raster work, selection and gates."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scoring as S
from ..functions.once import computed_once
from ..operators import pixels as P
from ..operators import raster as R
from ..operators import readiness as Y
from ..operators import selection as L
from ..operators import contracts as K
from ..operators.compare import report_deltas
from ..operators.refinement import refinement_report as refinement_of
from ..operators.refinement import rollout_totals
from ..operators.skew import salted_lookup, shuffled
from ..session import cut_lineage
from ..sources import domain as D
from .registry import query
from .vectorize import Config, sweep, sweep_open_faces, vectorize

R6 = lambda c: F.round(c, 6)


def _r(df, *names):
    return df.withColumns({n: R6(n) for n in names})


_METRICS = ["boundary_iou", "boundary_f1", "precision", "recall", "false_positive_rate"]


def _metrics_sql(keys: str, thresholds: list[float], source: str = "v_labels") -> str:
    group = f"{keys}, " if keys else ""
    values = ", ".join(f"({t})" for t in thresholds)
    return f"""
    SELECT {group}threshold, tp / greatest(predicted + expected - tp, 1) AS boundary_iou,
           2 * (tp / greatest(predicted, 1)) * (tp / greatest(expected, 1)) / greatest(tp / greatest(predicted, 1) + tp / greatest(expected, 1), 1e-12) AS boundary_f1,
           tp / greatest(predicted, 1) AS precision, tp / greatest(expected, 1) AS recall, fp / greatest(fp + tn, 1) AS false_positive_rate,
           predicted AS predicted_boundary_pixels, expected AS reference_boundary_pixels
    FROM (SELECT {group}t.threshold::DOUBLE AS threshold, count(*) FILTER (WHERE value >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE value >= threshold) AS predicted,
                 count(*) FILTER (WHERE label = 1) AS expected, count(*) FILTER (WHERE value >= threshold AND label = 0) AS fp,
                 count(*) FILTER (WHERE value < threshold AND label = 0) AS tn
          FROM {source}, (VALUES {values}) t(threshold) WHERE label <> 255 GROUP BY ALL)"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)


@query("A14 J23", f"SELECT raster_id, threshold, {_ROUNDED}, predicted_boundary_pixels, reference_boundary_pixels FROM ({_metrics_sql('raster_id', [0.5])})")
def pixel_metrics(spark, sf):
    return _r(P.threshold_metrics(D.pixel_labels(spark, sf), ["raster_id"], [0.5]), *_METRICS)


@query("A15 A14", f"SELECT threshold, {_ROUNDED}, predicted_boundary_pixels, reference_boundary_pixels FROM ({_metrics_sql('', P.SWEEP)})")
def threshold_sweep(spark, sf):
    return _r(P.threshold_metrics(D.pixel_labels(spark, sf), [], P.SWEEP), *_METRICS)


@query("A15 W13", f"""
    SELECT threshold, round(boundary_iou, 6) AS boundary_iou, round(precision, 6) AS precision FROM (
      SELECT *, max(boundary_iou) OVER () AS best FROM ({_metrics_sql('', P.SWEEP)})) m
    WHERE m.boundary_iou >= best - 0.001 ORDER BY m.precision DESC, false_positive_rate, threshold DESC LIMIT 1""")
def selected_threshold(spark, sf):
    swept = P.threshold_metrics(D.pixel_labels(spark, sf), [], P.SWEEP)
    return _r(L.near_best_threshold(swept), "boundary_iou", "precision").select("threshold", "boundary_iou", "precision")


@query("A16 J23", """
    SELECT raster_id, region, count(*) AS pixels, round(avg(value), 6) AS mean_probability, round(avg((value >= 0.5)::INT), 6) AS false_positive_rate
    FROM (SELECT *, CASE hard WHEN 1 THEN 'road' WHEN 2 THEN 'building' WHEN 3 THEN 'canal' WHEN 0 THEN CASE WHEN label = 0 THEN 'ordinary_background' END END AS region
          FROM v_labels WHERE label <> 255) WHERE region IS NOT NULL GROUP BY 1, 2""")
def hard_negative_audit(spark, sf):
    return _r(P.hard_negative_audit(D.pixel_labels(spark, sf), ["raster_id"], 0.5), "mean_probability", "false_positive_rate")


_AUDIT = """
    SELECT raster_id, count(*) FILTER (WHERE label <> 255) AS valid_pixels, count(*) FILTER (WHERE label = 1) AS boundary_pixels,
           count(*) FILTER (WHERE label = 1 AND hard > 0) AS conflict_pixels, count(*) FILTER (WHERE hard > 0) AS hard_pixels,
           count(*) FILTER (WHERE hard = 1) AS road_pixels, count(*) FILTER (WHERE hard = 2) AS building_pixels,
           count(*) FILTER (WHERE hard = 3) AS canal_pixels, count(*) FILTER (WHERE hard = 4) AS other_pixels
    FROM v_labels GROUP BY 1"""


@query("A17 R11", f"""
    SELECT *, round(boundary_pixels / greatest(valid_pixels, 1), 6) AS boundary_ratio, boundary_pixels = 0 AND hard_pixels > 0 AS negative_only FROM ({_AUDIT})""")
def boundary_audit(spark, sf):
    return _r(P.boundary_audit(D.pixel_labels(spark, sf), ["raster_id"]), "boundary_ratio")


@query("R11", "SELECT raster_id, row, col, hard FROM v_labels WHERE label = 1 AND hard > 0")
def conflict_pixels(spark, sf):
    return P.conflict_pixels(D.pixel_labels(spark, sf))


_BAND = "SELECT DISTINCT raster_id, row, col + d AS col FROM v_labels, (VALUES (-1), (0), (1)) t(d) WHERE label = 1"


@query("R11 G34", f"""
    SELECT l.raster_id, l.row, l.col, CASE WHEN b.col IS NOT NULL OR label = 255 THEN 0 ELSE hard END AS hard
    FROM v_labels l LEFT JOIN ({_BAND}) b ON b.raster_id = l.raster_id AND b.row = l.row AND b.col = l.col""")
def protected_hard_pixels(spark, sf):
    labels = D.pixel_labels(spark, sf)
    band = labels.where(F.col("label") == 1).select(
        "raster_id", "row", F.explode(F.array(F.col("col") - 1, F.col("col"), F.col("col") + 1)).alias("col"))
    return P.clear_protected(labels, band).select("raster_id", "row", "col", "hard")


_PATCHES = """
    SELECT raster_id, CAST(floor(row / 16) AS BIGINT) AS patch_row, CAST(floor(col / 16) AS BIGINT) AS patch_col,
           count(*) FILTER (WHERE label <> 255) AS labelled, count(*) FILTER (WHERE label = 1) AS boundary_pixels,
           count(*) FILTER (WHERE label = 0) AS background_pixels, count(*) FILTER (WHERE hard > 0) AS hard_pixels,
           CASE WHEN count(*) FILTER (WHERE label = 1) >= 23 THEN 'positive_boundary'
                WHEN count(*) FILTER (WHERE hard > 0) >= 147 THEN 'hard_negative' ELSE 'ordinary' END AS role,
           coalesce(nullif(concat_ws('+', CASE WHEN bool_or(hard = 1) THEN 'road' END, CASE WHEN bool_or(hard = 2) THEN 'building' END,
             CASE WHEN bool_or(hard = 3) THEN 'canal' END, CASE WHEN bool_or(hard = 4) THEN 'other' END), ''), 'ordinary') AS category
    FROM v_labels GROUP BY 1, 2, 3 HAVING count(*) = 256 AND count(*) FILTER (WHERE label <> 255) / count(*) >= 0.8"""


def _patches(spark, sf):
    return P.patches(D.pixel_labels(spark, sf), ["raster_id"], size=16, min_boundary=23, min_hard=147)


@query("A24 S15", _PATCHES)
def training_patches(spark, sf):
    return _patches(spark, sf).drop("pixels")


@query("A24", f"SELECT role, category, count(*) AS patches, count(*) FILTER (WHERE boundary_pixels = 0) AS boundary_free FROM ({_PATCHES}) GROUP BY 1, 2")
def patch_counts(spark, sf):
    return _patches(spark, sf).groupBy("role", "category").agg(
        F.count(F.lit(1)).alias("patches"), F.count_if(F.col("boundary_pixels") == 0).alias("boundary_free"))


@query("A25", f"SELECT round(greatest(1.5, least(4, sum(background_pixels) / greatest(sum(boundary_pixels), 1))), 6) AS positive_weight FROM ({_PATCHES})")
def positive_class_weight(spark, sf):
    return _patches(spark, sf).agg(
        R6(L.class_weight(F.sum("boundary_pixels"), F.sum("background_pixels"))).alias("positive_weight"))


@query("A23", f"""
    WITH g AS (SELECT CASE WHEN raster_id % 3 = 0 THEN 'feedback' ELSE 'reference' END AS source_group, role, count(*) AS patches FROM ({_PATCHES}) GROUP BY 1, 2),
    m AS (SELECT *, CASE source_group WHEN 'feedback' THEN 0.30 ELSE 0.70 END::DOUBLE AS sm,
                 CASE role WHEN 'positive_boundary' THEN 0.55 WHEN 'hard_negative' THEN 0.30 ELSE 0.15 END::DOUBLE AS rm FROM g)
    SELECT source_group, role, patches, round(sm / (SELECT sum(sm) FROM (SELECT DISTINCT source_group, sm FROM m))
             * rm / sum(rm) OVER (PARTITION BY source_group) / patches * sum(patches) OVER (), 6) AS weight FROM m""")
def sampling_weights(spark, sf):
    groups = _patches(spark, sf).withColumn(
        "source_group", F.when(F.col("raster_id") % 3 == 0, "feedback").otherwise("reference"))
    return _r(L.sampling_group_weights(groups), "weight").withColumn("patches", F.col("patches").cast("long"))


@query("S14", """
    SELECT raster_id, tile_row, tile_col, count(*) AS pixels, count(*) FILTER (WHERE floor(row / 16) = tile_row AND floor(col / 16) = tile_col) AS core_pixels
    FROM v_pixels JOIN (SELECT DISTINCT CAST(floor(row / 16) AS BIGINT) AS tile_row FROM v_pixels) ON row BETWEEN tile_row * 16 - 4 AND tile_row * 16 + 19
    JOIN (SELECT DISTINCT CAST(floor(col / 16) AS BIGINT) AS tile_col FROM v_pixels) ON col BETWEEN tile_col * 16 - 4 AND tile_col * 16 + 19
    GROUP BY 1, 2, 3 HAVING core_pixels > 0""")
def tile_grid(spark, sf):
    return P.tiles(D.pixels(spark, sf), 16, 4).groupBy("raster_id", "tile_row", "tile_col").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("is_core").alias("core_pixels")).where(F.col("core_pixels") > 0)


@query("S7 R1", "SELECT raster_id, count(*) AS pixels, count(*) FILTER (WHERE value >= 0) AS data_pixels, round(avg(value) FILTER (WHERE value >= 0), 6) AS mean_value FROM v_pixels GROUP BY 1")
def raster_coverage(spark, sf):
    return D.pixels(spark, sf).groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(R.is_data()).alias("data_pixels"),
        R6(F.avg(F.when(R.is_data(), F.col("value")))).alias("mean_value"))


# --- image evidence and morphology -------------------------------------------

def _gradient_sql(value: str, source: str) -> str:
    return f"""
    SELECT raster_id, row, col, sqrt(gx ** 2 + gy ** 2) AS magnitude FROM (
      SELECT *, CASE WHEN l IS NULL THEN r - g WHEN r IS NULL THEN g - l ELSE (r - l) / 2 END AS gx,
             CASE WHEN u IS NULL THEN d - g WHEN d IS NULL THEN g - u ELSE (d - u) / 2 END AS gy
      FROM (SELECT *, lag(g) OVER (PARTITION BY raster_id, row ORDER BY col) AS l, lead(g) OVER (PARTITION BY raster_id, row ORDER BY col) AS r,
                   lag(g) OVER (PARTITION BY raster_id, col ORDER BY row) AS u, lead(g) OVER (PARTITION BY raster_id, col ORDER BY row) AS d
            FROM (SELECT raster_id, row, col, {value} AS g FROM {source})))"""


_GREY = _gradient_sql("0.299 * red + 0.587 * green + 0.114 * blue", "v_bands")


@query("R7 W11 A26", f"""
    SELECT m.raster_id, m.row, m.col, round(CASE WHEN s.scale > 0 THEN least(1.0, m.magnitude / s.scale) ELSE 0 END, 6) AS edge
    FROM ({_GREY}) m JOIN (SELECT raster_id, quantile_cont(magnitude, 0.99) AS scale FROM ({_GREY}) GROUP BY 1) s USING (raster_id)""")
def edge_evidence(spark, sf):
    return _r(R.edge_evidence(D.image_bands(spark, sf)), "edge")


@query("R8 W11", f"""
    SELECT raster_id, row, col, round(magnitude / greatest(max(magnitude) OVER (PARTITION BY raster_id), 1e-6), 6) AS edge
    FROM ({_gradient_sql('(red + green + blue) / 3 / 255', 'v_bands')})""")
def edge_evidence_by_max(spark, sf):
    return _r(R.edge_evidence_by_max(D.image_bands(spark, sf)), "edge")


@query("R2 R7", f"""
    SELECT p.raster_id, p.row, p.col, round(0.6 * greatest(0, least(1, p.value)) + 0.4 * greatest(0, least(1, m.magnitude / greatest(x, 1e-6))), 6) AS fused
    FROM v_pixels p JOIN (SELECT *, max(magnitude) OVER (PARTITION BY raster_id) AS x FROM ({_gradient_sql('(red + green + blue) / 3 / 255', 'v_bands')})) m
      ON m.raster_id = p.raster_id AND m.row = p.row AND m.col = p.col""")
def fused_evidence(spark, sf):
    return _r(R.fuse(D.pixels(spark, sf), R.edge_evidence_by_max(D.image_bands(spark, sf)), 0.4), "fused").drop("value")


_CLOSED = """
    SELECT p.raster_id, p.row, p.col, p.value, min(q.m) AS closed FROM v_pixels p JOIN (
      SELECT p.raster_id, p.row, p.col, max((q.value >= 0.6)::INT) AS m FROM v_pixels p JOIN v_pixels q
        ON p.raster_id = q.raster_id AND q.row BETWEEN p.row - 1 AND p.row + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY 1, 2, 3) q
      ON p.raster_id = q.raster_id AND q.row BETWEEN p.row - 1 AND p.row + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY ALL"""


@query("W10 R3 R4", f"SELECT raster_id, row, col FROM ({_CLOSED}) WHERE closed = 0 AND value >= 0")
def open_faces(spark, sf):
    return R.open_faces(D.pixels(spark, sf), "value", 0.6, 3, 0)


@query("R10 U7 W10", f"""
    SELECT 0 AS config_id, raster_id, count(*) AS open_pixels FROM ({_CLOSED}) WHERE closed = 0 AND value >= 0 GROUP BY 2
    UNION ALL SELECT 1, raster_id, count(*) FROM v_pixels WHERE value >= 0 AND value < 0.5 GROUP BY 2""")
def swept_open_faces(spark, sf):
    settings = [(0.6, 3), (0.5, 1), (0.6, 3)]
    configs = list(dict.fromkeys(Config(threshold=t, close_pixels=k, boundary_width_pixels=0) for t, k in settings))
    return sweep_open_faces(D.pixels(spark, sf), configs).groupBy("config_id", "raster_id").agg(
        F.count(F.lit(1)).alias("open_pixels"))


_COMPONENTS = """
    WITH RECURSIVE open_px AS (SELECT raster_id, row, col, row * 2147483648 + col AS code FROM v_pixels WHERE value >= 0 AND value < 0.2),
    reach AS (
      SELECT raster_id, code, row, col, code AS src FROM open_px
      UNION
      SELECT o.raster_id, o.code, o.row, o.col, r.src FROM reach r JOIN open_px o
        ON o.raster_id = r.raster_id AND abs(o.row - r.row) + abs(o.col - r.col) = 1 WHERE r.src < o.code),
    comp AS (SELECT raster_id, code, row, col, min(src) AS component FROM reach GROUP BY ALL)"""


@query("R5 R3", _COMPONENTS + """
    SELECT raster_id, component, count(*) AS pixels, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col
    FROM comp GROUP BY 1, 2""")
def open_components(spark, sf):
    faces = R.open_faces(D.pixels(spark, sf), "value", 0.2, 1, 0)
    return R.face_sizes(R.connected_components(faces, tile=16))


@query("R5 R6 R9 V26 J22 W6 G21 G26 O8")
def vectorized_faces(spark, sf):
    config = Config(threshold=0.3, close_pixels=1, boundary_width_pixels=0, min_area_m2=20.0, max_area_m2=4000.0)
    rows = vectorize(D.pixels(spark, sf), D.raster_dims(spark, sf), config, tile=16)
    return _r(rows, "area_m2", "length_m", "compactness", "boundary_alignment_score", "raw_confidence").drop("rings")


@query("R6 V26", _COMPONENTS + """,
    -- which of the four pixels around each grid corner belong to the component
    around AS (
      SELECT raster_id, component, row + dr AS y, col + dc AS x, sum(1 << (2 * dr + dc))::INTEGER AS mask
      FROM comp, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc) GROUP BY ALL),
    corners AS (
      SELECT raster_id, component, sum(CASE WHEN mask IN (1, 2, 4, 8) THEN 1 WHEN mask IN (6, 9) THEN 2 ELSE 0 END) AS convex,
             sum(CASE WHEN mask IN (7, 11, 13, 14) THEN 1 ELSE 0 END) AS concave
      FROM around GROUP BY 1, 2),
    sides AS (
      SELECT p.raster_id, p.component, 4 * count(DISTINCT p.code) - count(q.code) AS length, count(DISTINCT p.code) AS pixels
      FROM comp p LEFT JOIN comp q ON q.raster_id = p.raster_id AND q.component = p.component AND abs(q.row - p.row) + abs(q.col - p.col) = 1
      GROUP BY 1, 2)
    SELECT raster_id, component, pixels, pixels::DOUBLE AS area, (convex + concave)::INTEGER AS vertex_count, length::DOUBLE AS length
    FROM corners JOIN sides USING (raster_id, component) WHERE convex - concave = 4""")
def component_outlines(spark, sf):
    """Exterior rings of the components without a hole, in pixel units."""
    faces = R.open_faces(D.pixels(spark, sf), "value", 0.2, 1, 0)
    components = cut_lineage(R.connected_components(faces, tile=16))
    rings = computed_once(R.face_rings(components), rings=F.array(F.transform("corners", lambda p: G.point(p["col"], p["row"]))))
    sized = rings.join(R.face_sizes(components).select("raster_id", "component", "pixels"), ["raster_id", "component"])
    measured = computed_once(sized, area=G.polygon_area("rings"), length=G.perimeter("rings"), vertex_count=G.vertex_count("rings"))
    return measured.where("area = pixels").select("raster_id", "component", "pixels", "area", "vertex_count", "length")


@query("R10 A11 W5 A10")
def calibration_trials(spark, sf):
    dims = D.raster_dims(spark, sf)
    from ..functions.geometry import box_polygon

    k = F.col("c_custkey")
    spots = D.table(spark, sf, "customer").select(
        (k % 8).alias("raster_id"), k.alias("id"), (k * 7 % 100).cast("double").alias("_dx"), (k * 13 % 100).cast("double").alias("_dy"))
    placed = salted_lookup(spots, dims.select("raster_id", "c", "f"), ["raster_id"], "inner", spread=["id"])
    x, y = F.col("c") + F.col("_dx"), F.col("f") - F.col("_dy") - 12
    refs = computed_once(placed, rings=box_polygon(x, y, x + 12, y + 12)).select("raster_id", "id", "rings")
    configs = [Config(threshold=t, close_pixels=1, boundary_width_pixels=0) for t in (0.25, 0.30)]
    return _r(sweep(D.pixels(spark, sf), dims, refs, configs, radius=20.0, tile=16),
              "mean_harmonic_iou", "worst_harmonic_iou", "objective")


@query("J21", "SELECT DISTINCT CAST(floor(vec_id / 64) AS BIGINT) AS raster_id, CASE WHEN floor(vec_id / 64) % 3 = 0 THEN 'missing' ELSE 'grid_differs' END AS rule FROM embeddings WHERE floor(vec_id / 64) % 3 < 2")
def grid_mismatches(spark, sf):
    dims = D.raster_dims(spark, sf)
    other = dims.where(F.col("raster_id") % 3 != 0).withColumn("c", F.when(F.col("raster_id") % 3 == 1, F.col("c") + 1).otherwise(F.col("c")))
    return K.grid_mismatches(dims, other)


# --- readiness ---------------------------------------------------------------

def _records(spark, sf):
    """Suppliers as dataset windows of a few manifests."""
    k = F.col("s_suppkey")
    split = F.element_at(F.array(*[F.lit(s) for s in ("train", "train", "train", "validation", "test")]), (k % 5 + 1).cast("int"))
    return D.table(spark, sf, "supplier").select(
        (k % 4).alias("manifest"), k.alias("id"), F.concat(F.lit("w"), k.cast("string")).alias("name"), split.alias("split"),
        F.when(k % 7 == 0, Y.FEEDBACK).alias("source"), (k % 3).alias("hard_negative_count"),
        F.create_map(F.lit("road"), k % 5, F.lit("building"), k % 3).alias("hard_negative_counts"),
        *[c.cast("double").alias(n) for n, c in {"minx": k * 10, "miny": k % 2 * 5, "maxx": k * 10 + 35, "maxy": k % 2 * 5 + 8}.items()])


_RECORDS = """(SELECT s_suppkey % 4 AS manifest, s_suppkey AS id, 'w' || CAST(s_suppkey AS VARCHAR) AS name,
      CASE s_suppkey % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END AS split,
      CASE WHEN s_suppkey % 7 = 0 THEN 'human_review_feedback' END AS source, s_suppkey % 3 AS hard_negative_count,
      s_suppkey * 10.0 AS minx, s_suppkey % 2 * 5 AS miny FROM supplier)"""


def _manifests(spark, sf):
    m = F.col("manifest")
    return _records(spark, sf).select("manifest").distinct().select(
        "manifest", F.when(m != 0, m == 1).alias("target_aoi_used_for_parameter_selection"),
        F.lit(None).cast("boolean").alias("target_aoi_used_for_test"),
        F.when(m != 3, F.lit(False)).alias("target_aoi_used_for_training_or_selection"),
        F.when(m == 2, F.lit(True)).alias("matched_training_ready"), (m == 3).alias("review_training_ready"))


_FINDINGS = f"""
    WITH c AS (SELECT manifest, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
                      count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE source IS NOT NULL) AS fb,
                      count(*) FILTER (WHERE source IS NOT NULL AND split <> 'train') AS fb_out FROM {_RECORDS} GROUP BY 1)
    SELECT manifest, 'blocker' AS level, n || ' needs at least ' || CAST(least_ AS VARCHAR) || ' windows; found ' || CAST(found AS VARCHAR) || '.' AS message
    FROM (SELECT manifest, UNNEST(['train', 'validation', 'test']) AS n, UNNEST([9, 3, 3]) AS least_, UNNEST([train, validation, test]) AS found FROM c) WHERE found < least_
    UNION ALL SELECT manifest, 'blocker', 'Manifest does not prove target-AOI exclusion from parameter selection.' FROM c WHERE manifest = 1
    UNION ALL SELECT manifest, 'blocker', 'Manifest does not prove target-AOI exclusion from testing.' FROM c WHERE manifest = 3
    UNION ALL SELECT manifest, 'blocker', 'Human-review feedback appears outside the training split.' FROM c WHERE fb_out > 0
    UNION ALL SELECT manifest, 'warning', 'No human-reviewed feedback windows are present; smoke testing may proceed on independent OSM negatives only.' FROM c WHERE fb = 0"""


@query("V21 S3", _FINDINGS)
def manifest_findings(spark, sf):
    return Y.manifest_findings(_manifests(spark, sf), _records(spark, sf), ["manifest"])


def _audited(spark, sf):
    audit = P.boundary_audit(D.pixel_labels(spark, sf), ["raster_id"])
    named = _records(spark, sf).withColumn("raster_id", F.col("id") % 6)
    return salted_lookup(named, audit, ["raster_id"], "inner", spread=["id"])


_RECORD_FINDINGS = f"""
    WITH a AS (SELECT r.manifest, r.name, r.source, r.hard_negative_count, x.*, boundary_pixels / greatest(valid_pixels, 1) AS ratio FROM {_RECORDS} r JOIN ({_AUDIT}) x ON x.raster_id = r.id % 6)
    SELECT manifest, name, name || ' has neither rasterized cadastral boundaries nor explicit hard-negative evidence.' AS message FROM a
    WHERE NOT (boundary_pixels > 0 OR (source IS NOT NULL AND hard_negative_count > 0 AND hard_pixels > 0))
    UNION ALL SELECT manifest, name, name || ' boundary mask is not thin (' || printf('%.2f%%', ratio * 100) || ' of valid pixels).' FROM a WHERE ratio > 0.15
    UNION ALL SELECT manifest, name, name || ' has ' || CAST(conflict_pixels AS VARCHAR) || ' boundary/hard-negative conflict pixels after protection.' FROM a WHERE conflict_pixels > 0"""


@query("A17 V22", _RECORD_FINDINGS)
def record_findings(spark, sf):
    return Y.record_findings(_audited(spark, sf), ["manifest"])


@query("A18 A17 J17 V23", f"""
    WITH a AS (SELECT r.manifest, r.source, x.*, boundary_pixels / greatest(valid_pixels, 1) AS ratio FROM {_RECORDS} r JOIN ({_AUDIT}) x ON x.raster_id = r.id % 6),
    f AS ({_FINDINGS}),
    n AS (SELECT manifest, count(*) FILTER (WHERE level = 'blocker') AS b, count(*) FILTER (WHERE level = 'warning') AS w FROM f GROUP BY 1),
    rec AS (SELECT manifest, sum((ratio > 0.15)::INT + (conflict_pixels > 0)::INT + (boundary_pixels = 0)::INT) AS b, sum(road_pixels) AS road_pixels,
                   sum(building_pixels) AS building_pixels, sum(canal_pixels) AS canal_pixels, sum(other_pixels) AS other_pixels FROM a GROUP BY 1),
    lk AS (SELECT l.manifest, count(*) AS b FROM {_RECORDS} l JOIN {_RECORDS} r ON l.manifest = r.manifest AND l.id < r.id AND l.split <> r.split
             AND l.minx <= r.minx + 35 AND r.minx <= l.minx + 35 AND l.miny <= r.miny + 8 AND r.miny <= l.miny + 8 GROUP BY 1),
    sc AS (SELECT manifest, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation,
                  count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE source IS NOT NULL) AS human_feedback_windows FROM {_RECORDS} GROUP BY 1)
    SELECT manifest, train, validation, test, CAST(road_pixels AS BIGINT) AS road_pixels, CAST(building_pixels AS BIGINT) AS building_pixels,
           CAST(canal_pixels AS BIGINT) AS canal_pixels, CAST(other_pixels AS BIGINT) AS other_pixels, human_feedback_windows,
           coalesce(lk.b, 0) = 0 AS spatial_split_isolated, '' AS missing_classes,
           CAST(coalesce(n.b, 0) + coalesce(rec.b, 0) + coalesce(lk.b, 0) AS BIGINT) AS blockers,
           coalesce(n.w, 0) + (human_feedback_windows > 0 AND manifest NOT IN (2, 3))::INT AS warnings,
           coalesce(n.b, 0) + coalesce(rec.b, 0) + coalesce(lk.b, 0) = 0 AS ready_for_smoke_test,
           coalesce(n.b, 0) + coalesce(rec.b, 0) + coalesce(lk.b, 0) = 0 AND manifest IN (2, 3) AS ready_for_heavy_training
    FROM sc LEFT JOIN n USING (manifest) LEFT JOIN rec USING (manifest) LEFT JOIN lk USING (manifest)""")
def readiness_report(spark, sf):
    records = _records(spark, sf)
    leaks = Y.split_leakage(records, ["manifest"])
    return Y.readiness_report(_manifests(spark, sf), records, _audited(spark, sf), leaks, ["manifest"])


@query("A18 J17 V21 V22", f"""
    SELECT manifest, level, message FROM ({_FINDINGS})
    UNION ALL SELECT manifest, 'blocker', message FROM ({_RECORD_FINDINGS})
    UNION ALL SELECT l.manifest, 'blocker', 'Spatial split leakage: ' || l.name || ' (' || l.split || ') intersects ' || r.name || ' (' || r.split || ').'
    FROM {_RECORDS} l JOIN {_RECORDS} r ON l.manifest = r.manifest AND l.id < r.id AND l.split <> r.split
      AND l.minx <= r.minx + 35 AND r.minx <= l.minx + 35 AND l.miny <= r.miny + 8 AND r.miny <= l.miny + 8""")
def readiness_messages(spark, sf):
    records = _records(spark, sf)
    return Y.readiness_messages(_manifests(spark, sf), records, _audited(spark, sf), Y.split_leakage(records, ["manifest"]), ["manifest"])


@query("A18 A31", f"""
    SELECT manifest, UNNEST(['road', 'building']) AS class, UNNEST([CAST(sum(id % 5) AS BIGINT), CAST(sum(id % 3) AS BIGINT)]) AS features FROM {_RECORDS} GROUP BY manifest""")
def merged_class_counts(spark, sf):
    return Y.merge_counts(_records(spark, sf), ["manifest"])


@query("A31", """
    SELECT parcel_id % 7 AS record, string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY type) AS counts
    FROM (SELECT parcel_id, type, count(*) AS n FROM (SELECT parcel_id % 7 AS parcel_id, type FROM v_anomalies) GROUP BY 1, 2) GROUP BY 1""")
def feature_counts_by_record(spark, sf):
    rows = Y.class_counts(D.anomalies(spark, sf).withColumn("record", F.col("parcel_id") % 7), ["record"], "type")
    text = F.transform(F.map_entries("class_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.select("record", F.array_join(text, ",").alias("counts"))


@query("A22 U1", """
    SELECT count(*) FILTER (WHERE parcel_id % 2 = 0) AS matched_reviewed_features, count(*) FILTER (WHERE parcel_id % 2 = 0 AND status = 'verified') AS positive_boundaries,
           count(*) FILTER (WHERE parcel_id % 2 = 0 AND status <> 'verified') AS hard_negatives, count(*) AS reviewed_features,
           (SELECT count(*) FROM nation) AS feedback_windows,
           (SELECT count(*) FROM supplier WHERE s_suppkey % 5 < 3) AS base_train, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 3) AS base_validation,
           (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 4) AS base_test,
           count(*) FILTER (WHERE parcel_id % 2 = 1) AS unmatched_reviewed_features,
           (SELECT count(*) FROM supplier WHERE s_suppkey % 5 < 3) + (SELECT count(*) FROM nation) AS combined_train,
           count(*) FILTER (WHERE parcel_id % 2 = 0) >= 100 AND count(*) FILTER (WHERE parcel_id % 2 = 0 AND status = 'verified') >= 40
             AND count(*) FILTER (WHERE parcel_id % 2 = 0 AND status <> 'verified') >= 40 AS matched_review_training_ready,
           count(*) FILTER (WHERE parcel_id % 2 = 0) >= 100 AND count(*) FILTER (WHERE parcel_id % 2 = 0 AND status = 'verified') >= 40
             AND count(*) FILTER (WHERE parcel_id % 2 = 0 AND status <> 'verified') >= 40 AS dataset_ready
    FROM v_parcels WHERE status IN ('verified', 'rejected')""")
def reviewed_dataset_report(spark, sf):
    from ..operators.review import MINIMUMS

    reviewed = D.parcels(spark, sf).where(F.col("status").isin("verified", "rejected")).withColumn(
        "training_role", F.when(F.col("status") == "verified", "positive_boundary").otherwise("hard_negative"))
    windows = D.table(spark, sf, "nation").select(F.concat(F.lit("reviewed_"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("train").alias("split"))
    return Y.dataset_report(reviewed, reviewed.where(F.col("parcel_id") % 2 == 0), _records(spark, sf), windows, MINIMUMS)


# --- refinement, gates, trials -----------------------------------------------

def _rollouts(spark, sf):
    """Line items as refinement rollouts of a parcel."""
    return D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("parcel_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("rollout"),
        F.round(F.col("l_discount") * 10, 6).alias("alignment"), F.round(F.col("l_tax"), 6).alias("overlap"),
        (F.col("l_quantity") / 50).alias("displacement"), (F.col("l_suppkey") % 10 / 10.0).alias("jagged"),
        F.round((F.col("l_partkey") % 100) / 100.0, 6).alias("alignment_before"), F.round((F.col("l_partkey") % 9) / 100.0, 6).alias("overlap_before"),
        (F.col("l_partkey") % 50 != 0).alias("valid"), (F.col("l_extendedprice") / 1e5).alias("reward"))


_ROLLOUTS = """(SELECT l_orderkey AS parcel_id, l_linenumber * 100000 + l_partkey AS rollout, round(l_discount * 10, 6) AS alignment, round(l_tax, 6) AS overlap,
      l_quantity / 50 AS displacement, (l_suppkey % 10) / 10.0::DOUBLE AS jagged, round((l_partkey % 100) / 100.0::DOUBLE, 6) AS alignment_before,
      round((l_partkey % 9) / 100.0::DOUBLE, 6) AS overlap_before, l_partkey % 50 <> 0 AS valid, l_extendedprice / 1e5 AS reward FROM lineitem)"""


@query("W4", f"""
    SELECT parcel_id, CAST(max(score) * 1000000 AS BIGINT) AS best_score FROM (
      SELECT parcel_id, round(3 * alignment - 4 * overlap - 0.2 * displacement - 0.1 * jagged, 6) AS score FROM {_ROLLOUTS}) GROUP BY 1""")
def best_rollouts(spark, sf):
    best = L.best_rollout(_rollouts(spark, sf), ["parcel_id"], ["alignment"])
    return best.select("parcel_id", F.round(F.round("score", 6) * 1000000).cast("long").alias("best_score"))


@query("V27", f"""
    SELECT parcel_id, rollout, round(CASE WHEN ok THEN alignment ELSE alignment_before END, 6) AS alignment, ok AS accepted
    FROM (SELECT *, valid AND alignment >= alignment_before AND overlap <= overlap_before + 1e-8 AS ok FROM {_ROLLOUTS})""")
def gated_rollouts(spark, sf):
    ok = S.deployment_gate(*[F.col(n) for n in ("valid", "alignment_before", "alignment", "overlap_before", "overlap")])
    return _rollouts(spark, sf).withColumn("accepted", ok).select(
        "parcel_id", "rollout", R6(F.when(F.col("accepted"), F.col("alignment")).otherwise(F.col("alignment_before"))).alias("alignment"), "accepted")


@query("A19 J6 A13", f"""
    WITH r AS (
      SELECT parcel_id, avg(displacement) AS displacement, avg(alignment_before) AS alignment_before, avg(alignment) AS alignment_after,
             avg(reward) AS reward_mean, stddev_pop(reward) AS reward_std FROM (SELECT * REPLACE ((rollout % 100000) AS parcel_id) FROM {_ROLLOUTS}) GROUP BY 1),
    m AS (
      SELECT project_id, count(*) FILTER (WHERE displacement > 0) AS changed_parcels, avg(displacement) AS mean_displacement,
             avg(r.alignment_before) AS alignment_before, avg(alignment_after) AS alignment_after, avg(reward_mean) AS reward_mean, avg(reward_std) AS reward_std
      FROM r JOIN v_lattice l ON l.id = r.parcel_id GROUP BY 1),
    b AS (SELECT project_id, count(*) AS n FROM v_overlap_pairs WHERE inter_area > 1.0 GROUP BY 1),
    a AS (SELECT a.project_id, count(*) AS n FROM v_ref_boxes a JOIN v_ref_boxes b ON a.project_id = b.project_id AND a.id < b.id
          WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 1.0 GROUP BY 1)
    SELECT p.project_id, p.n AS parcel_count_before, p.n AS parcel_count_after, 0 AS invalid_before, p.broken AS invalid_after,
           coalesce(b.n, 0) AS overlap_pairs_before, coalesce(a.n, 0) AS overlap_pairs_after, coalesce(changed_parcels, 0) AS changed_parcels,
           round(mean_displacement, 6) AS mean_displacement, round(alignment_before, 6) AS alignment_before, round(alignment_after, 6) AS alignment_after,
           round(reward_mean, 6) AS reward_mean, round(reward_std, 5) AS reward_std,
           p.broken = 0 AND coalesce(a.n, 0) <= coalesce(b.n, 0) AS topology_gate, coalesce(alignment_after >= alignment_before, false) AS alignment_gate
    FROM (SELECT project_id, count(*) AS n, 0 AS broken FROM v_lattice GROUP BY 1) p
    LEFT JOIN b USING (project_id) LEFT JOIN a USING (project_id) LEFT JOIN m USING (project_id)""")
def refinement_report(spark, sf):
    per_parcel = rollout_totals(_rollouts(spark, sf).withColumn("parcel_id", F.col("rollout") % 100000))
    placed = per_parcel.join(shuffled(D.parcels(spark, sf).select("parcel_id", "project_id")), "parcel_id")
    rows = refinement_of(D.parcel_layer(spark, sf), D.reference_layer(spark, sf), placed, ["project_id"])
    rounded = _r(rows, "mean_displacement", "alignment_before", "alignment_after", "reward_mean")
    return rounded.withColumn("reward_std", F.round("reward_std", 5))


@query("F9 F10 F11", f"""
    SELECT parcel_id, rollout, round(0.35 * alignment_before + 0.30 * alignment + 0.20 * (1 - overlap) + 0.15 * greatest(0, 1 - displacement), 6) AS refined_confidence,
           round(0.6 * (1 - overlap) + 0.25 * greatest(0, 1 - displacement) + 0.15 * (1 - jagged), 6) AS debug_confidence,
           round(alignment_before + alignment - 0.5 * jagged - 2 * overlap - 0.5 * displacement, 6) AS layer_quality FROM {_ROLLOUTS}""")
def refined_scores(spark, sf):
    c = {n: F.col(n) for n in ("alignment", "alignment_before", "overlap", "displacement", "jagged")}
    return _rollouts(spark, sf).select(
        "parcel_id", "rollout",
        R6(S.refined_confidence(c["alignment_before"], c["alignment"], 1 - c["overlap"], 1 - c["displacement"])).alias("refined_confidence"),
        R6(S.debug_confidence(1 - c["overlap"], 1 - c["displacement"], 1 - c["jagged"])).alias("debug_confidence"),
        R6(S.layer_quality(c["alignment_before"], c["alignment"], c["jagged"], c["overlap"], c["displacement"])).alias("layer_quality"))


def _trials(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 25).alias("config_id"), (F.col("o_orderkey") % 500 + F.when(F.col("o_custkey") % 25 == 7, -500).otherwise(0)).alias("candidate_count"),
                    (F.col("o_totalprice") / 500000).alias("harmonic_mean_best_iou"))


_TRIALS = """
    SELECT o_custkey % 25 AS config_id, avg(o_totalprice / 500000) AS mean_harmonic_iou, min(o_totalprice / 500000) AS worst_harmonic_iou,
           bool_and(o_orderkey % 500 - CASE WHEN o_custkey % 25 = 7 THEN 500 ELSE 0 END >= 1) AS viable,
           0.8 * avg(o_totalprice / 500000) + 0.2 * min(o_totalprice / 500000) AS objective FROM orders GROUP BY 1"""


@query("A11", f"SELECT config_id, round(mean_harmonic_iou, 6) AS mean_harmonic_iou, round(worst_harmonic_iou, 6) AS worst_harmonic_iou, viable, round(objective, 6) AS objective FROM ({_TRIALS})")
def trial_summaries(spark, sf):
    return _r(L.trial_summary(_trials(spark, sf)), "mean_harmonic_iou", "worst_harmonic_iou", "objective")


@query("W5", f"SELECT config_id, round(objective, 6) AS objective FROM ({_TRIALS.replace('>= 1', '>= 0')}) t WHERE viable ORDER BY t.objective DESC, config_id LIMIT 1")
def selected_trial(spark, sf):
    # one more candidate each, so that all trials but the unviable one of configuration 7 are in the running
    rows = _trials(spark, sf).withColumn("candidate_count", F.col("candidate_count") + 1)
    return _r(L.best_trial(L.trial_summary(rows)), "objective").select("config_id", "objective")


@query("U7", "SELECT p_size AS threshold, p_brand AS profile, min(p_partkey) AS config_id FROM part GROUP BY 1, 2")
def distinct_configurations(spark, sf):
    rows = D.table(spark, sf, "part").select(F.col("p_size").alias("threshold"), F.col("p_brand").alias("profile"), F.col("p_partkey").alias("config_id"))
    return L.distinct_configurations(rows, ["threshold", "profile"])


_GATE = [f"({_metrics_sql('raster_id', [t])})" for t in (0.3, 0.5, 0.6, 0.4)]


def _gate_pair(spark, sf):
    labels = D.pixel_labels(spark, sf)
    swept = P.threshold_metrics(labels, ["raster_id"], [0.3, 0.5, 0.6, 0.4])
    pack = F.struct(*_METRICS)
    # one row per raster and threshold meet on the raster id: validation and test, candidate and baseline
    return swept.groupBy("raster_id").agg(*[
        F.max(F.when(F.col("threshold") == t, pack)).alias(n) for n, t in (("c", 0.3), ("b", 0.5), ("ct", 0.6), ("bt", 0.4))])


@query("F12 F13 F14 J26", f"""
    SELECT c.raster_id, c.boundary_iou > b.boundary_iou AND c.boundary_f1 > b.boundary_f1 AND c.precision >= 0.98 * b.precision
             AND c.false_positive_rate <= b.false_positive_rate AS validation_gate,
           round(c.boundary_iou + 0.25 * c.boundary_f1 + 0.10 * c.precision - 0.05 * c.false_positive_rate, 6) AS checkpoint_score,
           c.raster_id % 5 <> 0 AND c.boundary_iou > b.boundary_iou AND c.boundary_f1 > b.boundary_f1 AND ct.boundary_iou > bt.boundary_iou
             AND ct.boundary_f1 > bt.boundary_f1 AND ct.precision >= 0.95 * bt.precision AND ct.false_positive_rate < bt.false_positive_rate AS pixel_gate,
           c.boundary_iou - b.boundary_iou > 0 AND c.boundary_f1 - b.boundary_f1 > 0 AND c.raster_id % 3 <> 1 AND c.raster_id % 4 <> 3 AS selection_eligible,
           c.boundary_iou - b.boundary_iou > 0 AND c.boundary_f1 - b.boundary_f1 > 0 AND c.raster_id % 3 <> 1 AND c.raster_id % 4 <> 3
             AND ct.boundary_iou - bt.boundary_iou > 0 AND ct.false_positive_rate - bt.false_positive_rate < 0 AND ct.boundary_f1 - bt.boundary_f1 > 0 AS final_eligible
    FROM {_GATE[0]} c JOIN {_GATE[1]} b USING (raster_id) JOIN {_GATE[2]} ct USING (raster_id) JOIN {_GATE[3]} bt USING (raster_id)""")
def promotion_gates(spark, sf):
    rows = _gate_pair(spark, sf)
    c, b, ct, bt = F.col("c"), F.col("b"), F.col("ct"), F.col("bt")
    # invalid and overlapping faces, and a broken chain, come from the raster's number
    invalid, overlapping = (F.col("raster_id") % 3 == 1).cast("int"), (F.col("raster_id") % 4 == 3).cast("int")
    selected = S.selection_eligible(
        c["boundary_iou"] - b["boundary_iou"], c["boundary_f1"] - b["boundary_f1"], invalid, overlapping)
    return rows.select(
        "raster_id", S.validation_gate(c, b).alias("validation_gate"),
        R6(S.checkpoint_score(c["boundary_iou"], c["boundary_f1"], c["precision"], c["false_positive_rate"])).alias("checkpoint_score"),
        S.pixel_promotion_gate(F.col("raster_id") % 5 != 0, c, b, ct, bt).alias("pixel_gate"), selected.alias("selection_eligible"),
        S.final_promotion_eligible(
            selected, ct["boundary_iou"] - bt["boundary_iou"], ct["false_positive_rate"] - bt["false_positive_rate"],
            ct["boundary_f1"] - bt["boundary_f1"]).alias("final_eligible"))


@query("F15 V27", f"""
    SELECT rollout, parcel_id, parcel_id % 3 <> 0 AND alignment > 0.2 AND alignment - alignment_before > 0 AND valid AND overlap <= overlap_before
           AND alignment >= alignment_before AS promoted FROM {_ROLLOUTS}""")
def final_vector_gates(spark, sf):
    n = lambda c: F.col(c)
    gates = F.when(n("parcel_id") % 3 != 0, True).when(n("parcel_id") % 2 == 0, False)  # a missing gate report counts as failed
    return _rollouts(spark, sf).select("rollout", "parcel_id", S.final_vector_promoted(
        gates, n("alignment") > 0.2, n("alignment") - n("alignment_before"), (~n("valid")).cast("int"),
        n("overlap_before"), n("overlap"), n("alignment_before"), n("alignment")).alias("promoted"))


@query("F15 J26 S4", f"""
    SELECT config_id, round(objective - base, 6) AS objective_delta, objective - base >= 0 AND mean_harmonic_iou - mean_base > 0 AS promoted
    FROM (SELECT *, lag(objective, 1, 0) OVER (ORDER BY config_id) AS base, lag(mean_harmonic_iou, 1, 0) OVER (ORDER BY config_id) AS mean_base FROM ({_TRIALS}))
    WHERE config_id > 0""")
def report_deltas_and_promotion(spark, sf):
    trials = L.trial_summary(_trials(spark, sf))
    base = trials.withColumn("config_id", F.col("config_id") + 1)
    rows = report_deltas(trials, base, ["config_id"], ["objective", "mean_harmonic_iou"]).where(F.col("config_id") > 0)
    return rows.select("config_id", R6("objective_delta").alias("objective_delta"), S.vector_promoted(
        F.col("objective_delta"), F.col("mean_harmonic_iou_delta"), F.lit(0)).alias("promoted"))
