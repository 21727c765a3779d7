"""Vector features as pixels: touched lines, distance bands, filled polygons.

Every edge (or polygon) emits only the pixel rows it reaches and, per row, the
span of columns it covers there, so the work is linear in the pixels found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_edges
from ..functions.once import computed_once
from .skew import salted_lookup

AFFINE = ["a", "b", "c", "d", "e", "f"]
# Half widths of roads and canals in metres, pixels of the safety band, class codes.
HALF_WIDTH = {"road": 3.0, "canal": 2.0}
SAFETY_PIXELS = 4
CLASS_CODE = {"road": 1, "building": 2, "canal": 3, "other": 4}


def _pixel_edges(features: DataFrame, dims: DataFrame, keep: list[str]) -> DataFrame:
    """Edges in pixel axes (u along columns, v along rows), v1 <= v2, with the grid size."""
    grid = dims.select("raster_id", *AFFINE, "height", "width")
    placed = salted_lookup(features, grid, ["raster_id"], "inner", spread=[keep[-1]])
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")

    def u(x: Column, y: Column) -> Column:
        return (F.col("e") * (x - F.col("c")) - F.col("b") * (y - F.col("f"))) / det

    def v(x: Column, y: Column) -> Column:
        return (F.col("a") * (y - F.col("f")) - F.col("d") * (x - F.col("c"))) / det

    edges = placed.select(*keep, *AFFINE, "height", "width", F.explode(polygon_edges("rings")).alias("g"))
    x1, y1, x2, y2 = (F.col(f"g.{n}") for n in ("x1", "y1", "x2", "y2"))
    pixel = computed_once(edges, u1=u(x1, y1), v1=v(x1, y1), u2=u(x2, y2), v2=v(x2, y2))
    up = F.col("v1") <= F.col("v2")
    ordered = {
        "_u1": F.when(up, F.col("u1")).otherwise(F.col("u2")), "_v1": F.least("v1", "v2"),
        "_u2": F.when(up, F.col("u2")).otherwise(F.col("u1")), "_v2": F.greatest("v1", "v2"),
    }
    size = F.greatest(F.abs(F.col("a")), F.abs(F.col("e")))
    return computed_once(pixel, **ordered).select(*keep, "_u1", "_v1", "_u2", "_v2", "height", "width", size.alias("_size"))


def _spans(edges: DataFrame, keep: list[str], reach: Column) -> DataFrame:
    """One row per pixel whose row band and column span (both widened by ``reach``) the edge meets."""
    wide = edges.withColumn("_reach", reach)
    first = F.greatest(F.floor(F.col("_v1") - F.col("_reach")), F.lit(0))
    last = F.least(F.floor(F.col("_v2") + F.col("_reach")), F.col("height") - 1)
    rows = wide.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("row"))
    low = F.greatest(F.col("_v1"), F.col("row") - F.col("_reach"))
    high = F.least(F.col("_v2"), F.col("row") + 1 + F.col("_reach"))
    slope = F.when(F.col("_v2") > F.col("_v1"), (F.col("_u2") - F.col("_u1")) / (F.col("_v2") - F.col("_v1")))
    a = F.coalesce(F.col("_u1") + slope * (low - F.col("_v1")), F.col("_u1"))
    b = F.coalesce(F.col("_u1") + slope * (high - F.col("_v1")), F.col("_u2"))
    start = F.greatest(F.floor(F.least(a, b) - F.col("_reach")), F.lit(0))
    end = F.least(F.floor(F.greatest(a, b) + F.col("_reach")), F.col("width") - 1)
    spans = computed_once(rows, _start=start, _end=end).where(F.col("_start") <= F.col("_end"))
    return spans.select("*", F.explode(F.sequence("_start", "_end")).alias("col"))


def touched_pixels(features: DataFrame, dims: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, row, col`` of every pixel a ring or line passes through (each pixel once)."""
    edges = _pixel_edges(features, dims, keep)
    return _spans(edges, keep, F.lit(0.0)).select(*keep, "row", "col").distinct()


def near_pixels(features: DataFrame, dims: DataFrame, keep: list[str], distance: Column | float) -> DataFrame:
    """``keep, row, col`` of pixels whose centre lies within ``distance`` metres of a ring or line."""
    meters = F.lit(float(distance)) if isinstance(distance, (int, float)) else distance
    edges = _pixel_edges(features, dims, keep)
    found = _spans(edges, keep, meters / F.col("_size"))
    pu, pv = F.col("col") + 0.5, F.col("row") + 0.5
    du, dv = F.col("_u2") - F.col("_u1"), F.col("_v2") - F.col("_v1")
    square = du * du + dv * dv
    t = F.when(square > 0, ((pu - F.col("_u1")) * du + (pv - F.col("_v1")) * dv) / square).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    gap = F.hypot(pu - (F.col("_u1") + t * du), pv - (F.col("_v1") + t * dv))
    return found.where(gap <= F.col("_reach")).select(*keep, "row", "col").distinct()


def filled_pixels(features: DataFrame, dims: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, row, col`` of pixels whose centre is inside the polygon (even-odd, holes excluded).

    Per polygon and pixel row, the crossings of the row's centre line are
    sorted and filled pairwise; a list holds at most the polygon's edge count.
    """
    edges = _pixel_edges(features, dims, keep)
    first = F.greatest(F.ceil(F.col("_v1") - 0.5), F.lit(0))
    last = F.least(F.ceil(F.col("_v2") - 0.5) - 1, F.col("height") - 1)
    rows = edges.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("row"))
    at = F.col("_u1") + (F.col("row") + 0.5 - F.col("_v1")) * (F.col("_u2") - F.col("_u1")) / (F.col("_v2") - F.col("_v1"))
    lines = rows.select(*keep, "row", "width", at.alias("_u")).groupBy(*keep, "row").agg(
        F.sort_array(F.collect_list("_u")).alias("_us"), F.first("width").alias("width"))
    pairs = lines.select(*keep, "row", "width", "_us", F.explode(
        F.sequence(F.lit(0), F.floor(F.size("_us") / 2) - 1)).alias("_i"))
    start = F.greatest(F.ceil(F.get("_us", (F.col("_i") * 2).cast("int")) - 0.5), F.lit(0))
    end = F.least(F.ceil(F.get("_us", (F.col("_i") * 2 + 1).cast("int")) - 0.5) - 1, F.col("width") - 1)
    spans = computed_once(pairs, _start=start, _end=end).where(F.col("_start") <= F.col("_end"))
    return spans.select(*keep, "row", F.explode(F.sequence("_start", "_end")).alias("col"))


def hard_negative_pixels(features: DataFrame, dims: DataFrame) -> DataFrame:
    """``raster_id, row, col, hard``: class code per pixel; the later feature wins.

    ``features``: raster_id, id, feature_type, seq, rings. Roads and canals are
    widened lines, buildings and others filled polygons with their outline.
    """
    keep = ["raster_id", "feature_type", "seq", "id"]
    areas = features.where(F.col("feature_type").isin("building", "other"))
    parts = [filled_pixels(areas, dims, keep), touched_pixels(areas, dims, keep)]
    parts += [near_pixels(features.where(F.col("feature_type") == kind), dims, keep, width)
              for kind, width in HALF_WIDTH.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    code = F.create_map(*[F.lit(v) for pair in CLASS_CODE.items() for v in pair])[F.col("feature_type")]
    return every.groupBy("raster_id", "row", "col").agg(F.max_by(code, "seq").alias("hard"))


def label_pixels(pixels: DataFrame, boundary: DataFrame, hard: DataFrame, band: DataFrame) -> DataFrame:
    """Training masks: ``label`` (1 boundary, 0 other, 255 nodata) and ``hard`` cleared in the safety band."""
    from .pixels import IGNORE
    from .raster import PIXEL, is_data

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select(*PIXEL).distinct().withColumn(name, F.lit(True))

    joined = (
        pixels.join(mark(boundary, "_line"), PIXEL, "left")
        .join(hard.select(*PIXEL, F.col("hard").alias("_hard")), PIXEL, "left")
        .join(mark(band, "_band"), PIXEL, "left")
    )
    ok = is_data()
    return joined.select(
        *PIXEL, "value",
        F.when(~ok, IGNORE).when(F.col("_line").isNotNull(), 1).otherwise(0).alias("label"),
        F.when(ok & F.col("_band").isNull(), F.coalesce("_hard", F.lit(0))).otherwise(0).alias("hard"))
