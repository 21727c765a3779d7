"""Topology of a layer: overlaps, invalid polygons, slivers and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area, with_bbox
from ..functions.once import computed_once
from ..session import cut_lineage
from .copies import SHAPE, distinct_shapes, with_shape_keys
from .grid import self_candidates
from .overlay import intersection_area, overlaps
from .skew import exact_quantiles, salted_lookup, shuffled
from .validity import with_validity

# Overlap noise limits in square metres and the sliver share.
VALIDATION_EPS = 1.0
COUNT_EPS = 0.01
SLIVER_RATIO = 0.05
KINDS = ("invalid_geometry", "sliver", "overlap")


def overlap_areas(shapes: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, l_id, r_id, l_area, r_area, l_copies, r_copies, inter_area`` of distinct shapes."""
    pairs = self_candidates(shapes, scope, ["rings", "area", "copies"])
    return intersection_area(
        pairs, [*scope, "l_id", "r_id"], "l_rings", "r_rings",
        carry=["l_area", "r_area", "l_copies", "r_copies"],
    )


def overlap_flags(layer: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, id`` of parcels that overlap (neither covering) another parcel of the scope.

    Copies of one geometry cover each other, so they flag nobody; a copied
    shape that overlaps another shape flags all its copies.
    """
    shapes = cut_lineage(distinct_shapes(layer, scope))
    hit = overlap_areas(shapes, scope).where(
        overlaps(F.col("l_area"), F.col("r_area"), F.col("inter_area")))
    ids = hit.select(*scope, F.explode(F.array("l_id", "r_id")).alias("id")).distinct()
    flagged = shapes.join(shuffled(ids), [*scope, "id"], "left_semi").select(*scope, *SHAPE)
    members = with_shape_keys(layer).select(*scope, *SHAPE, "id")
    return salted_lookup(members, flagged, [*scope, *SHAPE], "inner", spread=["id"], large=True).select(*scope, "id")


def topology_violation(layer: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, id, topology_violation``: invalid geometry or an overlap, one row per parcel."""
    checked = with_validity(layer.select(*scope, "id", "rings"))
    valid = checked.where("is_valid")
    flags = overlap_flags(valid, scope).withColumn("_over", F.lit(True))
    return checked.join(shuffled(flags), [*scope, "id"], "left").select(
        *scope, "id",
        (~F.col("is_valid") | F.coalesce(F.col("_over"), F.lit(False))).alias("topology_violation"))


def overlap_pairs(layer: DataFrame, scope: list[str], eps: float = VALIDATION_EPS) -> DataFrame:
    """Every pair ``l_id < r_id`` of a valid layer that shares more than ``eps``."""
    boxed = with_bbox(layer.select(*scope, "id", "rings"))
    pairs = self_candidates(boxed, scope, ["rings"])
    areas = intersection_area(pairs, [*scope, "l_id", "r_id"], "l_rings", "r_rings")
    return areas.where(F.col("inter_area") > eps)


def overlap_totals(layer: DataFrame, scope: list[str], eps: float = COUNT_EPS) -> DataFrame:
    """Number and total area of overlapping pairs per scope, copies counted by arithmetic."""
    shapes = cut_lineage(distinct_shapes(layer, scope))
    between = overlap_areas(shapes, scope).where(F.col("inter_area") > eps).select(
        *scope,
        (F.col("l_copies") * F.col("r_copies")).alias("n"),
        (F.col("l_copies") * F.col("r_copies") * F.col("inter_area")).alias("a"),
    )
    same = F.col("copies") * (F.col("copies") - 1) / 2
    within = shapes.where((F.col("copies") > 1) & (F.col("area") > eps)).select(
        *scope, same.cast("long").alias("n"), (same * F.col("area")).alias("a"))
    every = layer.select(*scope).distinct().select(*scope, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("a"))
    return between.unionByName(within).unionByName(every).groupBy(*scope).agg(
        F.sum("n").alias("overlap_pairs"), F.sum("a").alias("overlap_area"))


def slivers(valid: DataFrame, scope: list[str], ratio: float = SLIVER_RATIO) -> DataFrame:
    """``scope, id, area, median_area`` of valid parcels below ``ratio`` of the median valid area."""
    sized = computed_once(valid.select(*scope, "id", "rings"), area=polygon_area("rings")).drop("rings")
    medians = exact_quantiles(sized, scope, "area", {"median_area": 0.5})
    joined = salted_lookup(sized, medians, scope, "inner", spread=["id"], large=True)
    return joined.where(F.col("area") < F.col("median_area") * ratio)


def topology_violations(layer: DataFrame, scope: list[str], eps: float = VALIDATION_EPS,
                        ratio: float = SLIVER_RATIO) -> DataFrame:
    """``scope, id, type, detail`` rows of invalid, sliver and overlap findings."""
    checked = cut_lineage(with_validity(layer.select(*scope, "id", "rings")))
    valid = checked.where("is_valid")
    invalid = checked.where(~F.col("is_valid")).select(
        *scope, "id", F.lit("invalid_geometry").alias("type"), F.col("invalid_reason").alias("detail"))
    thin = slivers(valid, scope, ratio).select(
        *scope, "id", F.lit("sliver").alias("type"),
        F.format_string(
            "area=%.2f sq m is below %.0f%% of median parcel area (%.2f sq m)",
            "area", F.lit(100.0 * ratio), "median_area").alias("detail"))
    lapped = overlap_pairs(valid, scope, eps).select(
        *scope, F.col("l_id").alias("id"), F.lit("overlap").alias("type"),
        F.concat(F.lit("overlaps feature "), F.col("r_id").cast("string"),
                 F.format_string(" by %.2f sq m", "inter_area")).alias("detail"))
    return invalid.unionByName(thin).unionByName(lapped)


def topology_counts(layer: DataFrame, scope: list[str], eps: float = VALIDATION_EPS, ratio: float = SLIVER_RATIO) -> DataFrame:
    """``scope, parcels, invalid_geometry, sliver, overlap``: counts by kind, one row per scope.

    Validity is looked at once. Overlapping pairs are counted on distinct shapes, copies by arithmetic, so a pile of
    equal polygons costs nothing and no pair is listed to be counted.
    """
    checked = cut_lineage(with_validity(layer.select(*scope, "id", "rings")))
    valid = checked.where("is_valid")
    seen = checked.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("parcels"), F.count_if(~F.col("is_valid")).alias("invalid_geometry"))
    thin = slivers(valid, scope, ratio).groupBy(*scope).agg(F.count(F.lit(1)).alias("sliver"))
    lapped = overlap_totals(valid, scope, eps).select(*scope, F.col("overlap_pairs").alias("overlap"))
    return seen.join(thin, scope, "left").join(lapped, scope, "left").fillna(0, ["sliver", "overlap"])


def topology_report(layer: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope: counts by kind and the ``valid`` flag."""
    counted = topology_counts(layer, scope)
    return counted.drop("parcels").withColumn("valid", sum(F.col(k) for k in KINDS) == 0)


def violation_counts(layer: DataFrame, scope: list[str]) -> DataFrame:
    """``type, violations`` over all scopes; kinds without a finding are left out."""
    totals = topology_counts(layer, scope).agg(*[F.sum(k).alias(k) for k in KINDS])
    return totals.unpivot([], list(KINDS), "type", "violations").where(F.col("violations") > 0)
