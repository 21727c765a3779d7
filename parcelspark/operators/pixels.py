"""Metrics and audits over labelled pixel tables: one pass, conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ignore label, class codes, thresholds of the sweep, patch rules.
IGNORE = 255
HARD_CLASSES = {1: "road", 2: "building", 3: "canal", 4: "other"}
AUDITED = ("road", "building", "canal")
SWEEP = [round(0.30 + 0.05 * i, 2) for i in range(10)]
PATCH = 512
MIN_LABELLED = 0.8
MIN_BOUNDARY_PIXELS = 32
MIN_HARD_PIXELS = 500
THIN_RATIO = 0.15


def _valid() -> Column:
    return F.col("label") != IGNORE


def _metrics(threshold: Column, tp: Column, predicted: Column, expected: Column, valid: Column) -> list[Column]:
    one = F.lit(1)
    union = predicted + expected - tp
    fp = predicted - tp
    precision = tp / F.greatest(predicted, one)
    recall = tp / F.greatest(expected, one)
    return [
        threshold.alias("threshold"),
        (tp / F.greatest(union, one)).alias("boundary_iou"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("boundary_f1"),
        precision.alias("precision"),
        recall.alias("recall"),
        # all valid background pixels: predicted or not
        (fp / F.greatest(valid - expected, one)).alias("false_positive_rate"),
        predicted.alias("predicted_boundary_pixels"),
        expected.alias("reference_boundary_pixels"),
    ]


def threshold_metrics(pixels: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Confusion metrics per key group and threshold.

    All thresholds share one scan: each adds two conditional counts to the
    same aggregate, so rows are never multiplied by the sweep.
    """
    valid = _valid()
    truth = valid & (F.col("label") == 1)
    counts = [F.count_if(truth).alias("_expected"), F.count_if(valid).alias("_valid")]
    for i, t in enumerate(thresholds):
        hit = valid & (F.col("value") >= t)
        counts += [F.count_if(hit).alias(f"_p{i}"), F.count_if(hit & truth).alias(f"_t{i}")]
    summed = pixels.groupBy(*keys).agg(*counts)
    sweep = F.explode(F.array(*[
        F.struct(F.lit(t).alias("th"), F.col(f"_t{i}").alias("tp"), F.col(f"_p{i}").alias("p"))
        for i, t in enumerate(thresholds)
    ])).alias("s")
    rows = summed.select(*keys, "_expected", "_valid", sweep)
    return rows.select(*keys, *_metrics(
        F.col("s.th"), F.col("s.tp"), F.col("s.p"), F.col("_expected"), F.col("_valid")))


def hard_negative_audit(pixels: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``keys, region, pixels, mean_probability, false_positive_rate`` per class and plain background."""
    name = F.create_map(*[F.lit(v) for pair in HARD_CLASSES.items() for v in pair])[F.col("hard")]
    region = F.when(name.isin(*AUDITED), name).when(
        (F.col("hard") == 0) & (F.col("label") == 0), "ordinary_background")
    return (
        pixels.where(_valid()).withColumn("region", region).where(F.col("region").isNotNull())
        .groupBy(*keys, "region")
        .agg(
            F.count(F.lit(1)).alias("pixels"),
            F.avg("value").alias("mean_probability"),
            F.avg((F.col("value") >= threshold).cast("double")).alias("false_positive_rate"),
        )
    )


def boundary_audit(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Readiness counts of each record: boundary share, hard pixels per class, conflicts, thinness."""
    valid = _valid()
    boundary = valid & (F.col("label") == 1)
    hard = F.col("hard") > 0
    agg = pixels.groupBy(*keys).agg(
        F.count_if(valid).alias("valid_pixels"),
        F.count_if(boundary).alias("boundary_pixels"),
        F.count_if((F.col("label") == 1) & hard).alias("conflict_pixels"),
        F.count_if(hard).alias("hard_pixels"),
        *[F.count_if(F.col("hard") == code).alias(f"{name}_pixels") for code, name in HARD_CLASSES.items()],
    )
    ratio = F.col("boundary_pixels") / F.greatest(F.col("valid_pixels"), F.lit(1))
    return agg.withColumn("boundary_ratio", ratio).withColumn(
        "negative_only", (F.col("boundary_pixels") == 0) & (F.col("hard_pixels") > 0))


def clear_protected(pixels: DataFrame, band: DataFrame) -> DataFrame:
    """Set ``hard`` to 0 on pixels of the safety band around boundaries (``raster_id,row,col``)."""
    marked = band.select("raster_id", "row", "col").distinct().withColumn("_band", F.lit(True))
    return pixels.join(marked, ["raster_id", "row", "col"], "left").withColumn(
        "hard", F.when(F.col("_band").isNotNull() | (F.col("label") == IGNORE), 0).otherwise(F.col("hard"))
    ).drop("_band")


def conflict_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.where((F.col("label") == 1) & (F.col("hard") > 0)).select("raster_id", "row", "col", "hard")


def patches(pixels: DataFrame, keys: list[str], dims: DataFrame | None = None, size: int = PATCH,
            min_labelled: float = MIN_LABELLED, min_boundary: int = MIN_BOUNDARY_PIXELS,
            min_hard: int = MIN_HARD_PIXELS) -> DataFrame:
    """Full ``size`` x ``size`` patches that are labelled enough, with role and class category."""
    tile = pixels.withColumn("patch_row", F.floor(F.col("row") / size)).withColumn(
        "patch_col", F.floor(F.col("col") / size))
    agg = tile.groupBy(*keys, "patch_row", "patch_col").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(_valid()).alias("labelled"),
        F.count_if(F.col("label") == 1).alias("boundary_pixels"),
        F.count_if(F.col("label") == 0).alias("background_pixels"),
        F.count_if(F.col("hard") > 0).alias("hard_pixels"),
        *[F.bool_or(F.col("hard") == code).alias(f"_{name}") for code, name in HARD_CLASSES.items()],
    )
    kept = agg.where((F.col("pixels") == size * size) & (F.col("labelled") / F.col("pixels") >= min_labelled))
    present = F.concat_ws("+", *[F.when(F.col(f"_{n}"), n) for n in HARD_CLASSES.values()])
    role = (
        F.when(F.col("boundary_pixels") >= min_boundary, "positive_boundary")
        .when(F.col("hard_pixels") >= min_hard, "hard_negative").otherwise("ordinary")
    )
    return kept.withColumn("category", F.when(present == "", "ordinary").otherwise(present)).withColumn(
        "role", role).drop(*[f"_{n}" for n in HARD_CLASSES.values()])


def tiles(pixels: DataFrame, size: int = PATCH, margin: int = 0) -> DataFrame:
    """Pixels filed under their tile, and under neighbour tiles within ``margin`` pixels of the edge."""
    if margin >= size:
        raise ValueError("margin must be smaller than the tile")

    def spans(axis: str) -> Column:
        v = F.col(axis)
        return F.sequence(F.floor((v - margin) / size), F.floor((v + margin) / size))

    filed = pixels.withColumn("tile_row", F.explode(spans("row"))).withColumn(
        "tile_col", F.explode(spans("col")))
    inside = (F.floor(F.col("row") / size) == F.col("tile_row")) & (F.floor(F.col("col") / size) == F.col("tile_col"))
    return filed.withColumn("is_core", inside).where((F.col("tile_row") >= 0) & (F.col("tile_col") >= 0))
