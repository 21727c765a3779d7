"""Pixel-table image work: evidence, morphology, enclosed faces and their rings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import (
    compactness, map_of, perimeter, pixel_of, polygon_area, vertex_count,
)
from ..functions.once import computed_once
from ..session import cut_lineage
from .boundary import boundary_samples
from .shapes import simplify_rings
from .skew import exact_quantiles, salted_lookup
from .validity import invalid_reason

PIXEL = ["raster_id", "row", "col"]
TILE = 256


def is_data(value: str = "value") -> Column:
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))


def _difference(value: str, along: str, across: str, keys: list[str]) -> Column:
    """Central difference along one axis, one-sided at the first and last pixel."""
    line = Window.partitionBy(*keys, across).orderBy(along)
    v, before, after = F.col(value), F.lag(value).over(line), F.lead(value).over(line)
    return (
        F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2.0)
    )


def gradient_magnitude(pixels: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Add ``magnitude`` of the image gradient; each window is one raster row or column."""
    keys = keys or ["raster_id"]
    along_row = pixels.withColumn("_gx", _difference(value, "col", "row", keys))
    both = along_row.withColumn("_gy", _difference(value, "row", "col", keys))
    return both.withColumn("magnitude", F.hypot("_gx", "_gy")).drop("_gx", "_gy")


def grey(red: str = "red", green: str = "green", blue: str = "blue") -> Column:
    return 0.299 * F.col(red) + 0.587 * F.col(green) + 0.114 * F.col(blue)


def edge_evidence(bands: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """``raster_id,row,col,edge``: gradient over its 99th percentile among valid pixels, clipped to 0..1."""
    sloped = gradient_magnitude(bands.select(*PIXEL, grey().alias("grey")), "grey").drop("grey")
    if valid is not None:
        sloped = sloped.join(valid.select(*PIXEL, F.lit(True).alias("_ok")), PIXEL, "left").withColumn(
            "_ok", F.coalesce("_ok", F.lit(False)))
    else:
        sloped = sloped.withColumn("_ok", F.lit(True))
    scale = exact_quantiles(sloped.where("_ok"), ["raster_id"], "magnitude", {"scale": 0.99})
    scaled = salted_lookup(sloped, scale, ["raster_id"], "left", spread=["row", "col"])
    edge = F.when(F.col("_ok") & (F.col("scale") > 0),
                  F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("magnitude") / F.col("scale")))).otherwise(0.0)
    return scaled.select(*PIXEL, edge.alias("edge"))


def edge_evidence_by_max(bands: DataFrame) -> DataFrame:
    """Variant: mean of the bands over 255, gradient over its largest value."""
    mean = (F.col("red") + F.col("green") + F.col("blue")) / 3 / 255
    sloped = gradient_magnitude(bands.select(*PIXEL, mean.alias("grey")), "grey").drop("grey")
    peak = sloped.groupBy("raster_id").agg(F.max("magnitude").alias("peak"))
    scaled = salted_lookup(sloped, peak, ["raster_id"], "left", spread=["row", "col"])
    return scaled.select(
        *PIXEL, (F.col("magnitude") / F.greatest(F.col("peak"), F.lit(1e-6))).alias("edge"))


def fused_value(value: Column, edge: Column, weight: float) -> Column:
    """(1-w) of the probability and w of the edge evidence, both clipped."""
    if not 0 <= weight <= 1:
        raise ValueError("the edge weight is a share")

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    return (1 - weight) * clip(value) + weight * clip(edge)


def fuse(pixels: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """Add ``fused``."""
    joined = pixels.join(edges, PIXEL)
    return joined.withColumn("fused", fused_value(F.col("value"), F.col("edge"), weight)).drop("edge")


def _sweep(value: str, along: str, across: str, keys: list[str], reach: int, fn) -> Column:
    frame = Window.partitionBy(*keys, across).orderBy(along).rangeBetween(-reach, reach)
    return fn(value).over(frame)


def check_kernel(kernel: int, width: int) -> None:
    if kernel < 1 or kernel % 2 == 0 or width < 0:
        raise ValueError("the closing kernel is odd and the dilation not negative")


def close_mask(pixels: DataFrame, mask: str, kernel: int, width: int, keys: list[str] | None = None) -> DataFrame:
    """Binary closing with a ``kernel`` square and a dilation by ``width``, on an integer mask column.

    Square windows are separable; rows and columns alternate so that
    neighbouring passes over the same axis share one shuffle.
    """
    check_kernel(kernel, width)
    keys = keys or ["raster_id"]
    half = kernel // 2
    passes: list[tuple[str, str, int, object]] = []
    if kernel > 1:
        passes += [("col", "row", half, F.max), ("row", "col", half, F.max),
                   ("row", "col", half, F.min), ("col", "row", half, F.min)]
    if width:
        passes += [("col", "row", width, F.max), ("row", "col", width, F.max)]
    return reduce(
        lambda df, p: df.withColumn(mask, _sweep(mask, p[0], p[1], keys, p[2], p[3])), passes, pixels)


def open_faces(pixels: DataFrame, value: str, threshold: float, close_pixels: int, width: int,
               keys: list[str] | None = None) -> DataFrame:
    """Valid pixels that are not part of the closed boundary network."""
    keys = keys or ["raster_id"]
    valid = is_data("value")
    masked = pixels.withColumn("_valid", valid).withColumn(
        "_mask", F.when(valid & (F.col(value) >= threshold), 1).otherwise(0))
    closed = close_mask(masked, "_mask", close_pixels, width, keys)
    return closed.where(F.col("_valid") & (F.col("_mask") == 0)).select(*keys, "row", "col")


# --- connected components -------------------------------------------------

_SHIFT = 1 << 31


LABELLED_ROWS = 1 << 18  # pixels of whole tiles that are labelled together


def _lines(group_starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number per pixel, for pixels sorted by group, row and column: that of its row, one more for the next row of the group, gaps elsewhere."""
    n = len(rows)
    step = np.zeros(n, np.int64)
    changed = np.r_[True, rows[1:] != rows[:-1]] | group_starts
    next_row = np.r_[False, rows[1:] == rows[:-1] + 1] & ~group_starts
    step[changed] = np.where(next_row[changed], 1, 2)
    return np.cumsum(step)


def _labels(group_starts: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """4-connected labels inside each group of pixels (sorted by group, row, column); a label is the first pixel of its component.

    Of repeated pixels the last one joins its neighbours, the others stand alone.
    """
    codes = (_lines(group_starts, rows) << 32) + (cols - cols.min())
    last = np.flatnonzero(np.r_[codes[1:] != codes[:-1], True])
    codes = codes[last]
    a, b = [], []
    for step in (1, 1 << 32):
        at = np.minimum(np.searchsorted(codes, codes + step), len(codes) - 1)
        met = np.flatnonzero(codes[at] == codes + step)
        a.append(met)
        b.append(at[met])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(codes))
    while True:
        best = label.copy()
        np.minimum.at(best, a, label[b])
        np.minimum.at(best, b, label[a])
        # hang the old root below the new one, then shorten the chains
        np.minimum.at(best, label, best)
        best = best[best]
        if np.array_equal(best, label):
            break
        label = best
    own = np.arange(len(rows))
    own[last] = last[label]
    return rows[own] * _SHIFT + cols[own]


def _label_tiles(n_keys: int):
    """Stream over pixels sorted by ``n_keys`` columns, row and column: adds ``local``, whole tiles at a time."""

    def starts(table: pa.Table) -> np.ndarray:
        changed = np.zeros(table.num_rows, bool)
        changed[:1] = True
        for i in range(n_keys):
            codes = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed[1:] |= codes[1:] != codes[:-1]
        return changed

    def labelled(table: pa.Table, group_starts: np.ndarray):
        # a pixel without a row is in a tile of such pixels alone
        rows, cols = (table.column(c).combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy() for c in ("row", "col"))
        return table.append_column("local", pa.array(_labels(group_starts, rows, cols))).to_batches()

    def kernel(batches):
        waiting: list[pa.RecordBatch] = []
        held, wanted = 0, LABELLED_ROWS
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < wanted:
                continue
            table = pa.Table.from_batches(waiting)
            group_starts = starts(table)
            cut = int(np.flatnonzero(group_starts)[-1])
            if cut:
                yield from labelled(table.slice(0, cut), group_starts[:cut])
            waiting = table.slice(cut).to_batches()
            held -= cut
            wanted = max(LABELLED_ROWS, 2 * held)
        if waiting:
            table = pa.Table.from_batches(waiting)
            yield from labelled(table, starts(table))

    return kernel


def connected_components(faces: DataFrame, keys: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Add ``component`` to each pixel: the least pixel code of its 4-connected region.

    Tiles of fixed size are labelled on their own, so a task never holds more
    than one tile. Labels that meet at tile borders form a small graph, whose
    least labels spread by rounds of neighbour minimum and pointer jumping.
    """
    keys = keys or ["raster_id"]
    tiled = faces.select(*keys, "row", "col",
                         F.floor(F.col("row") / tile).alias("tile_row"), F.floor(F.col("col") / tile).alias("tile_col"))
    place = [*keys, "tile_row", "tile_col"]
    tiled = tiled.select(*place, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in tiled.schema.fields] + ["local bigint"])
    labelled = tiled.repartition(*place).sortWithinPartitions(*place, "row", "col").mapInArrow(_label_tiles(len(place)), schema)
    labelled = cut_lineage(labelled.select(*keys, "row", "col", "local"))

    def border(axis: str, other: str) -> DataFrame:
        """Label pairs of neighbouring pixels on both sides of a tile border."""
        last = labelled.where(F.col(axis) % tile == tile - 1).select(
            *keys, (F.col(axis) + 1).alias(axis), other, F.col("local").alias("u"))
        first = labelled.where((F.col(axis) % tile == 0) & (F.col(axis) > 0)).select(
            *keys, axis, other, F.col("local").alias("v"))
        return last.join(first, [*keys, axis, other]).select(*keys, "u", "v")

    links = border("col", "row").unionByName(border("row", "col")).distinct()
    links = cut_lineage(links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    if links.isEmpty():
        return labelled.withColumnRenamed("local", "component")
    labels = links.select(*keys, F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        by_v = labels.select(*keys, F.col("node").alias("v"), F.col("label").alias("other"))
        around = links.join(by_v, [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("other").alias("around"))
        lower = labels.join(around, [*keys, "node"]).select(
            *keys, "node", "label", F.least("label", "around").alias("_next"))
        # the old root learns the lowest label any of its members saw
        roots = lower.groupBy(*keys, F.col("label").alias("node")).agg(F.min("_next").alias("_root"))
        hung = lower.join(roots, [*keys, "node"], "left").select(
            *keys, "node", F.col("label").alias("_old"), F.least("_next", F.coalesce("_root", "_next")).alias("_next"))
        target = hung.select(*keys, F.col("node").alias("_next"), F.col("_next").alias("_jump"))
        jumped = salted_lookup(hung, target, [*keys, "_next"], "left", spread=["node"])
        updated = cut_lineage(jumped.select(
            *keys, "node", "_old", F.least("_next", F.coalesce("_jump", "_next")).alias("label")))
        moved = updated.where(F.col("_old") != F.col("label"))
        labels = updated.drop("_old")
        if moved.isEmpty():
            break
    final = labels.select(*keys, F.col("node").alias("local"), "label")
    joined = salted_lookup(labelled, final, [*keys, "local"], "left", spread=["row", "col"])
    return joined.select(*keys, "row", "col", F.coalesce("label", "local").alias("component"))


# --- faces ----------------------------------------------------------------

def face_sizes(components: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["raster_id"]
    return components.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.min("col").alias("min_col"), F.max("col").alias("max_col"),
    )


TRACED_PIXELS = 1 << 18  # pixels of whole components whose rings are put in order together


def _traces(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exterior rings of components (component k: the pixels at[k] .. at[k+1]) as (row, col) of their corners, closed, and the points of each ring.

    Every pixel side without a neighbour is a directed edge with the component on its right. Its successor
    follows from the two pixels ahead; where four edges meet, the ring stays at the pixel it came from. The
    edges are put in order by pointer jumping from the top side of the first pixel, so the memory depends on the
    number of pixels alone, not on their box. Straight steps are merged.
    """
    parts = len(at) - 1
    part = np.repeat(np.arange(parts), np.diff(at))
    order = np.lexsort((codes, part))
    codes = codes[order]
    n = len(codes)
    if not n:
        return np.empty(0), np.empty(0), np.zeros(parts, np.int64)
    begins = np.zeros(n, bool)
    begins[at[:-1][np.diff(at) > 0]] = True
    pixel_row, pixel_col = codes // _SHIFT, codes % _SHIFT
    places = (_lines(begins, pixel_row) << 32) + pixel_col + 1
    # neighbours by heading: east, south, west, north; columns may not wrap into the next row
    near = np.full((4, n), -1)
    for h, step in enumerate((1, 1 << 32, -1, -(1 << 32))):
        to = np.minimum(np.searchsorted(places, places + step), n - 1)
        near[h] = np.where(places[to] == places + step, to, -1)
    pixel, heading = np.divmod(np.flatnonzero((near[[3, 0, 1, 2]] < 0).T.reshape(-1)), 4)
    number = np.full(4 * n, -1)
    number[4 * pixel + heading] = np.arange(len(pixel))
    ahead = near[heading, pixel]
    ahead_left = np.where(ahead >= 0, near[(heading + 3) % 4, ahead], -1)
    to_pixel = np.where(ahead < 0, pixel, np.where(ahead_left >= 0, ahead_left, ahead))
    to_heading = np.where(ahead < 0, heading + 1, np.where(ahead_left >= 0, heading + 3, heading)) % 4
    follows = number[4 * to_pixel + to_heading]
    # steps from each edge until the first edge of its component comes again; edges of other rings never reach it
    first = number[4 * at[part[pixel]]]
    steps, jump = np.ones(len(pixel), np.int64), follows.copy()
    ended = jump == first
    for _ in range(len(pixel).bit_length()):
        moving = np.flatnonzero(~ended)
        if not len(moving):
            break
        to = jump[moving]
        steps[moving] += steps[to]
        ended[moving] = ended[to]
        jump[moving] = jump[to]
    ring = np.flatnonzero(ended)
    ring = ring[np.lexsort((-steps[ring], part[pixel[ring]]))]
    of = part[pixel[ring]]
    edges = np.bincount(of, minlength=parts)
    ring_at = np.cumsum(edges) - edges
    before = np.arange(len(ring)) - 1
    before[ring_at[edges > 0]] = (ring_at + edges - 1)[edges > 0]
    turned = heading[ring] != heading[ring[before]]
    pixel, heading, of = pixel[ring[turned]], heading[ring[turned]], of[turned]
    rows = pixel_row[pixel] + ((heading == 2) | (heading == 3))
    cols = pixel_col[pixel] + ((heading == 1) | (heading == 2))
    # the first corner closes each ring
    corners = np.bincount(of, minlength=parts)
    some = corners > 0
    corner_at = np.cumsum(corners) - corners
    ends = (corner_at + corners)[some]
    rows, cols = (np.insert(v, ends, v[corner_at[some]]).astype(float) for v in (rows, cols))
    return rows, cols, corners + some


def _trace(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exterior ring of one component as (row, col) of its corners, closed."""
    return _traces(codes, np.array([0, len(codes)]))[:2]


_CORNERS = T.ArrayType(T.StructType([T.StructField("row", T.DoubleType()), T.StructField("col", T.DoubleType())]))


@F.arrow_udf(_CORNERS)
def _corners(codes: pa.Array) -> pa.Array:
    flat, at = codes.flatten().to_numpy(), codes.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    parts = []
    i = 0
    while i < len(codes):
        j = max(i + 1, int(np.searchsorted(at, at[i] + TRACED_PIXELS, "right")) - 1)
        parts.append(_traces(flat[at[i]:at[j]], at[i:j + 1] - at[i]))
        i = j
    rows, cols, sizes = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(3))
    ring_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(ring_at, pa.StructArray.from_arrays([pa.array(rows), pa.array(cols)], ["row", "col"]))


def face_rings(components: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, component, corners``: exterior ring of each component.

    Call it on components of bounded pixel count only (:func:`parcel_faces` filters by it first), because the
    pixels of one component are gathered in one row before its ring is put in order. Their box may be of any size.
    """
    keys = keys or ["raster_id"]
    code = F.col("row") * F.lit(_SHIFT) + F.col("col")
    gathered = components.groupBy(*keys, "component").agg(F.collect_list(code).alias("_codes"))
    return computed_once(gathered, corners=_corners("_codes")).drop("_codes")


AFFINE = ["a", "b", "c", "d", "e", "f"]


def parcel_faces(
    faces: DataFrame, dims: DataFrame, keys: list[str] | None = None, *,
    edge_buffer_pixels: int = 2, min_area: float = 20.0, max_area: float = 250_000.0,
    simplify_tolerance: float = 0.25, max_vertices: int = 10_000, min_compactness: float = 0.0,
    tile: int = TILE,
) -> DataFrame:
    """Enclosed faces as polygons in map units, filtered by position, area and shape.

    A component's pixel area is at most the area inside its exterior ring and
    its pixel box equals the ring's box, so both limits are applied to pixel
    counts before any ring is walked: what remains is bounded by ``max_area``.
    """
    if not 0 < min_area < max_area or max_vertices < 4:
        raise ValueError("face limits need 0 < min_area < max_area and at least 4 vertices")
    keys = keys or ["raster_id"]
    grid = dims.select("raster_id", *AFFINE, "height", "width")
    components = connected_components(faces, keys, tile)
    sized = salted_lookup(face_sizes(components, keys), grid, ["raster_id"], "inner", spread=["component"])
    pixel_area = F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d"))
    inset = edge_buffer_pixels
    possible = sized.where(
        (F.col("pixels") * pixel_area <= max_area)
        & (F.col("min_row") >= inset) & (F.col("max_row") + 1 <= F.col("height") - inset)
        & (F.col("min_col") >= inset) & (F.col("max_col") + 1 <= F.col("width") - inset)
    ).select(*keys, "component", "pixels", *AFFINE)
    members = salted_lookup(
        components, possible.select(*keys, "component", F.lit(True).alias("_keep")), [*keys, "component"],
        "inner", spread=["row", "col"]).drop("_keep")
    rings = face_rings(members, keys).join(possible, [*keys, "component"])
    affine = [F.col(n) for n in AFFINE]
    mapped = computed_once(rings, rings=F.array(F.transform(
        "corners", lambda p: map_of(p["row"], p["col"], *affine)))).drop("corners")
    raw = computed_once(mapped, _area=polygon_area("rings"), _bad=invalid_reason("rings"))
    raw = raw.where(F.col("_bad").isNull() & F.col("_area").between(min_area, max_area)).drop("_area", "_bad")
    return shape_filter(simplify_faces(raw, simplify_tolerance), max_vertices, min_compactness)


def simplify_faces(layer: DataFrame, tolerance: float) -> DataFrame:
    """Simplify ``rings``; keep the original where the simpler ring is not valid."""
    if tolerance <= 0:
        return layer
    tried = computed_once(layer, _simple=simplify_rings(tolerance)(F.col("rings")))
    judged = computed_once(tried, _why=invalid_reason("_simple"))
    return judged.withColumn(
        "rings", F.when(F.col("_why").isNull(), F.col("_simple")).otherwise(F.col("rings"))).drop("_simple", "_why")


def shape_filter(layer: DataFrame, max_vertices: int, min_compactness: float) -> DataFrame:
    """Add ``area, length, vertices, compactness`` and drop over-detailed or stringy polygons."""
    sized = computed_once(layer, area_m2=polygon_area("rings"), length_m=perimeter("rings"), vertex_count=vertex_count("rings"))
    return sized.withColumn("compactness", compactness(F.col("area_m2"), F.col("length_m"))).where(
        (F.col("vertex_count") <= max_vertices) & (F.col("compactness") >= min_compactness))


def sample_probability(layer: DataFrame, pixels: DataFrame, dims: DataFrame, keys: list[str],
                       value: str = "value", out: str = "alignment") -> DataFrame:
    """Add the mean pixel value under 48 to 512 points of each exterior; nodata is skipped, none gives 0."""
    size = F.greatest(F.abs(F.col("a")), F.abs(F.col("e")), F.lit(1e-6))
    count = F.greatest(F.lit(48), F.least(F.lit(512), F.floor(F.col("length_m") / size)))
    grid = dims.select("raster_id", *AFFINE, "height", "width")
    placed = layer.drop(*[c for c in (*AFFINE, "height", "width") if c in layer.columns])
    placed = salted_lookup(placed, grid, ["raster_id"], "inner", spread=[keys[-1]])
    carried = list(dict.fromkeys([*keys, "raster_id", *AFFINE]))
    samples = boundary_samples(placed, carried, "rings", count)
    at = computed_once(samples, _p=pixel_of(F.col("sx"), F.col("sy"), *[F.col(n) for n in AFFINE]))
    # several samples can fall on one pixel: count them before the join
    # (samples beside the raster find no pixel and drop out)
    counted = at.select(*dict.fromkeys([*keys, "raster_id"]), "_p.row", "_p.col").groupBy(*dict.fromkeys([*keys, "raster_id"]), "row", "col").agg(F.count(F.lit(1)).alias("_n"))
    pixel_keys = PIXEL + [k for k in keys if k in pixels.columns and k not in PIXEL]
    known = pixels.where(F.col(value) >= 0).select(*pixel_keys, F.col(value).alias("_value"))
    means = counted.join(known, pixel_keys).groupBy(*keys).agg(
        (F.sum(F.col("_value") * F.col("_n")) / F.sum("_n")).alias(out))
    return layer.join(means, keys, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
