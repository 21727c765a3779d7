"""Comparison of a candidate layer with a reference layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..functions.once import computed_once
from ..session import cut_lineage
from .boundary import symmetric_boundary_distance
from .copies import SHAPE, distinct_shapes, with_shape_keys
from .grid import cross_candidates
from .nearest import nearest_polygon
from .overlay import intersection_area, iou
from .skew import exact_quantiles, salted_lookup, shuffled
from .validity import with_validity


def _shapes(layer: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct shapes, computed once: the grid statistics, the pairs and the copies all read them."""
    return cut_lineage(distinct_shapes(layer, scope))


def _shape_pairs(source: DataFrame, target: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, l_id, r_id, iou`` of distinct shapes that share area."""
    pairs = cross_candidates(source, target, scope, ["rings", "area"], ["rings", "area"])
    measured = intersection_area(
        pairs, [*scope, "l_id", "r_id"], "l_rings", "r_rings", carry=["l_area", "r_area"])
    return measured.select(
        *scope, "l_id", "r_id", iou(F.col("l_area"), F.col("r_area"), F.col("inter_area")).alias("iou"))


def _best(layer: DataFrame, shapes: DataFrame, pairs: DataFrame, side: str, scope: list[str]) -> DataFrame:
    """Best value per distinct shape, given to all copies of it; 0 where no pair was found."""
    best = pairs.groupBy(*scope, F.col(side).alias("id")).agg(F.max("iou").alias("best_iou"))
    scored = shapes.select(*scope, *SHAPE, "id").join(shuffled(best), [*scope, "id"], "left").select(*scope, *SHAPE, "best_iou")
    members = with_shape_keys(layer.select(*scope, "id", "rings")).select(*scope, *SHAPE, "id")
    return salted_lookup(members, scored, [*scope, *SHAPE], "left", spread=["id"], large=True).select(
        *scope, "id", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"))


def best_iou(source: DataFrame, target: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, id, best_iou``: best overlap ratio of each source polygon with any target."""
    shapes = _shapes(source, scope)
    return _best(source, shapes, _shape_pairs(shapes, _shapes(target, scope), scope), "l_id", scope)


def best_iou_both_ways(source: DataFrame, target: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(best per source, best per target) from one table of pairs."""
    left, right = _shapes(source, scope), _shapes(target, scope)
    pairs = cut_lineage(_shape_pairs(left, right, scope))
    return _best(source, left, pairs, "l_id", scope), _best(target, right, pairs, "r_id", scope)


def boundary_distances(source: DataFrame, target: DataFrame, scope: list[str], radius: float,
                       count: int = 96) -> DataFrame:
    """``scope, source_id, target_id, boundary_distance`` of each source and its nearest target."""
    nearest = nearest_polygon(source, target, scope, radius)
    from_source = source.select(*scope, F.col("id").alias("source_id"), F.col("rings").alias("a"))
    from_target = target.select(*scope, F.col("id").alias("target_id"), F.col("rings").alias("b"))
    pairs = nearest.join(shuffled(from_source), [*scope, "source_id"])
    pairs = salted_lookup(pairs, from_target, [*scope, "target_id"], "inner", spread=["source_id"], large=True)
    return symmetric_boundary_distance(pairs, [*scope, "source_id", "target_id"], "a", "b", count)


def compare_layers(candidates: DataFrame, references: DataFrame, scope: list[str], radius: float,
                   distances: bool = True) -> DataFrame:
    """One row per scope: counts, mean best IoU both ways, matches, distances, median areas."""
    group = scope
    per_candidate, per_reference = best_iou_both_ways(candidates, references, scope)
    cand = per_candidate.groupBy(*group).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.avg("best_iou").alias("candidate_mean_best_iou"),
    )
    ref = per_reference.groupBy(*group).agg(
        F.count(F.lit(1)).alias("reference_count"),
        F.avg("best_iou").alias("reference_mean_best_iou"),
        F.count_if(F.col("best_iou") >= 0.5).alias("reference_matched_iou_50"),
        F.count_if(F.col("best_iou") >= 0.75).alias("reference_matched_iou_75"),
    )
    invalid = with_validity(candidates.select(*scope, "id", "rings")).groupBy(*group).agg(
        F.count_if(~F.col("is_valid")).alias("invalid_candidates"))

    def medians(layer: DataFrame, name: str) -> DataFrame:
        sized = computed_once(layer.select(*scope, "rings"), area=polygon_area("rings")).drop("rings")
        return exact_quantiles(sized, scope, "area", {name: 0.5})

    parts = [ref, invalid, medians(candidates, "median_candidate_area_m2"),
             medians(references, "median_reference_area_m2")]
    if distances:
        parts.append(boundary_distances(candidates, references, scope, radius).groupBy(*group).agg(
            F.avg("boundary_distance").alias("mean_symmetric_boundary_distance_m")))
    out = cand
    for part in parts:
        out = out.join(part, scope, "full_outer") if scope else _beside(out, part)
    precision = F.coalesce("candidate_mean_best_iou", F.lit(0.0))
    recall = F.coalesce("reference_mean_best_iou", F.lit(0.0))
    counts = ["candidate_count", "reference_count", "invalid_candidates",
              "reference_matched_iou_50", "reference_matched_iou_75"]
    return (
        out.fillna(0, counts)
        .withColumn("candidate_mean_best_iou", precision)
        .withColumn("reference_mean_best_iou", recall)
        .withColumn("harmonic_mean_best_iou", harmonic(F.col("candidate_mean_best_iou"), F.col("reference_mean_best_iou")))
    )


def harmonic(precision, recall):
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames side by side, joined on a constant key."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "full_outer").drop("_one")


def report_deltas(candidate: DataFrame, baseline: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """Candidate minus baseline for each metric, joined on the report keys."""
    base = baseline.select(*on, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    return candidate.join(base, on, "left").select(
        *candidate.columns, *[(F.col(m) - F.col(f"baseline_{m}")).alias(f"{m}_delta") for m in metrics])
