"""Scoring and decision columns: health, discrepancy, anomalies, priority, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band limits, health weights, priority weights, anomaly limits.
HIGH_MIN = 0.85
MEDIUM_MIN = 0.60
HEALTH_WEIGHTS = (0.4, 0.2, 0.2, 0.2)
PRIORITY_WEIGHTS = (0.40, 0.25, 0.15, 0.10, 0.10)
LOW_CONFIDENCE = 0.60
DISCREPANCY_LIMIT = 0.30
SEVERE_DISCREPANCY = 0.60
VOLATILITY_LIMIT = 0.50
TOPOLOGY_SCORE_LIMIT = 0.999
ROUTINE_REASON = "low-risk parcel; routine review"
# Refinement confidence, debug confidence and layer-quality weights.
REFINED_WEIGHTS = (0.35, 0.30, 0.20, 0.15)
DEBUG_WEIGHTS = (0.6, 0.25, 0.15)
QUALITY_WEIGHTS = {"iou": 1.0, "edge_alignment": 1.0, "regularity": -0.5, "topology": -2.0, "deviation": -0.5}
# Rollout choice and checkpoint ranking weights.
ROLLOUT_WEIGHTS = (3.0, -4.0, -0.2, -0.1)
CHECKPOINT_WEIGHTS = (1.0, 0.25, 0.10, -0.05)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def weighted(weights, columns) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in zip(weights, columns)])


def confidence_band(score: Column) -> Column:
    return (
        F.when(score >= HIGH_MIN, "HIGH").when(score >= MEDIUM_MIN, "MEDIUM")
        .when(score.isNotNull(), "LOW")
    )


def band_action(band: Column) -> Column:
    """What a band means for the reviewer."""
    return F.when(band == "HIGH", "eligible").when(band == "MEDIUM", "review").when(band == "LOW", "field")


def health_score(confidence: Column, topology: Column, discrepancy: Column, volatility: Column,
                 weights=HEALTH_WEIGHTS) -> Column:
    parts = [
        clip(confidence),
        F.when(topology, 0.0).otherwise(1.0),
        1.0 - clip(discrepancy),
        1.0 - clip(volatility),
    ]
    return F.round(clip(weighted(weights, parts)), 4)


def health_band(score: Column) -> Column:
    return F.lower(confidence_band(score))


def health_text(score: Column, confidence: Column, topology: Column, discrepancy: Column, volatility: Column) -> Column:
    return F.format_string(
        "Health score %.2f: confidence=%.2f, topology=%s, discrepancy=%.2f, historical_volatility=%.2f.",
        score, clip(confidence), F.when(topology, "violation").otherwise("valid"), discrepancy, volatility,
    )


def severity(discrepancy: Column) -> Column:
    return (
        F.when(discrepancy >= SEVERE_DISCREPANCY, "high")
        .when(discrepancy >= DISCREPANCY_LIMIT, "medium")
        .otherwise("low")
    )


def discrepancy(area_ratio: Column, boundary_ratio: Column) -> Column:
    """0.4 area share + 0.6 boundary share, each capped at one."""
    return F.least(
        F.lit(1.0),
        0.4 * F.least(area_ratio, F.lit(1.0)) + 0.6 * F.least(boundary_ratio, F.lit(1.0)),
    )


def area_ratio(current: Column, historical: Column) -> Column:
    """|change| over the historical area, with the 1e-9 floor."""
    return F.abs(current - historical) / F.greatest(historical, F.lit(1e-9))


def capped_ratio(current: Column, baseline: Column) -> Column:
    """|change| over the baseline capped at one; 0 when there is no baseline area."""
    return F.when(
        F.coalesce(baseline, F.lit(0.0)) != 0,
        F.least(F.lit(1.0), F.abs(current - baseline) / baseline),
    ).otherwise(F.lit(0.0))


def boundary_ratio(symmetric_difference: Column, union: Column) -> Column:
    return F.when(union > 0, symmetric_difference / union).otherwise(F.lit(0.0))


def anomalies(confidence: Column, discrepancy_: Column, topology: Column, volatility: Column,
              topology_magnitude: Column | None = None) -> Column:
    """array<struct<type,magnitude,explanation>> of the rules that fire, in rule order."""
    magnitude = F.lit(1.0) if topology_magnitude is None else F.round(topology_magnitude, 4)

    def item(kind: str, size: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), size.cast("double").alias("magnitude"), text.alias("explanation")
        )

    rules = [
        (confidence < LOW_CONFIDENCE, item(
            "boundary_shift", F.round(1.0 - confidence, 4),
            F.format_string(
                "Low AI/RL confidence (%.2f); parcel requires field verification.", confidence))),
        (discrepancy_ >= DISCREPANCY_LIMIT, item(
            "boundary_shift", F.round(discrepancy_, 4),
            F.lit("Current parcel geometry differs significantly from the existing/historical record."))),
        (topology, item(
            "topology_break", magnitude,
            F.lit("Parcel contains a topology violation such as invalid geometry or overlap."))),
        (volatility >= VOLATILITY_LIMIT, item(
            "encroachment", F.round(volatility, 4),
            F.lit("Parcel shows substantial historical boundary/area volatility."))),
    ]
    return F.filter(F.array(*[F.when(cond, value) for cond, value in rules]), lambda a: a.isNotNull())


def priority_score(confidence: Column, discrepancy_: Column, volatility: Column,
                   anomaly_count: Column, topology: Column, weights=PRIORITY_WEIGHTS) -> Column:
    parts = [
        1.0 - clip(confidence),
        clip(discrepancy_),
        clip(volatility),
        F.least(F.lit(1.0), anomaly_count / 3.0),
        F.when(topology, 1.0).otherwise(0.0),
    ]
    return F.round(clip(weighted(weights, parts)), 4)


def priority_reason(confidence: Column, discrepancy_: Column, volatility: Column,
                    anomaly_count: Column, topology: Column) -> Column:
    text = F.concat_ws(
        ", ",
        F.when(confidence < LOW_CONFIDENCE, "low confidence"),
        F.when(discrepancy_ >= DISCREPANCY_LIMIT, "historical/record discrepancy"),
        F.when(volatility >= VOLATILITY_LIMIT, "historical instability"),
        F.when(anomaly_count > 0, F.concat(anomaly_count.cast("string"), F.lit(" anomaly(s)"))),
        F.when(topology, "topology violation"),
    )
    return F.when(text == "", ROUTINE_REASON).otherwise(text)


def refined_confidence(segmentation: Column, alignment: Column, topology: Column, deviation: Column) -> Column:
    return clip(weighted(REFINED_WEIGHTS, [clip(c) for c in (segmentation, alignment, topology, deviation)]))


def debug_confidence(topology: Column, deviation: Column, regularity: Column) -> Column:
    return clip(weighted(DEBUG_WEIGHTS, [clip(c) for c in (topology, deviation, regularity)]))


def layer_quality(iou: Column, edge_alignment: Column, regularity: Column, topology: Column, deviation: Column) -> Column:
    return weighted(QUALITY_WEIGHTS.values(), [iou, edge_alignment, regularity, topology, deviation])


def regularity_penalty(compact: Column, vertices: Column, hull_vertices: Column, degenerate: Column) -> Column:
    """Half compactness deficit, half excess vertices over the hull; 1.0 when degenerate."""
    hull = F.greatest(hull_vertices, F.lit(1))
    excess = F.least(F.greatest(vertices - hull, F.lit(0)) / hull, F.lit(1.0))
    return F.when(degenerate, 1.0).otherwise(0.5 * (1.0 - clip(compact)) + 0.5 * excess)


def rollout_score(alignment: Column, overlap: Column, displacement: Column, jagged: Column) -> Column:
    return weighted(ROLLOUT_WEIGHTS, [alignment, overlap, displacement, jagged])


def checkpoint_score(iou: Column, f1: Column, precision: Column, fpr: Column) -> Column:
    return weighted(CHECKPOINT_WEIGHTS, [iou, f1, precision, fpr])


def validation_gate(c: Column, b: Column) -> Column:
    """Candidate metrics against baseline metrics (structs of boundary_iou, boundary_f1, precision, false_positive_rate)."""
    return (
        (c["boundary_iou"] > b["boundary_iou"])
        & (c["boundary_f1"] > b["boundary_f1"])
        & (c["precision"] >= 0.98 * b["precision"])
        & (c["false_positive_rate"] <= b["false_positive_rate"])
    )


def pixel_promotion_gate(chain_ok: Column, cv: Column, bv: Column, ct: Column, bt: Column) -> Column:
    """Validation and test metrics must both improve; precision may lose at most 5 %."""
    return (
        chain_ok
        & (cv["boundary_iou"] > bv["boundary_iou"]) & (cv["boundary_f1"] > bv["boundary_f1"])
        & (ct["boundary_iou"] > bt["boundary_iou"]) & (ct["boundary_f1"] > bt["boundary_f1"])
        & (ct["precision"] >= 0.95 * bt["precision"])
        & (ct["false_positive_rate"] < bt["false_positive_rate"])
    )


def selection_eligible(pixel_iou_delta: Column, polygon_iou_delta: Column, invalid: Column, overlaps: Column) -> Column:
    return (pixel_iou_delta > 0) & (polygon_iou_delta > 0) & (invalid == 0) & (overlaps == 0)


def final_promotion_eligible(selection: Column, test_iou_delta: Column, test_fpr_delta: Column, target_delta: Column) -> Column:
    return F.coalesce(
        selection & (test_iou_delta > 0) & (test_fpr_delta < 0) & (target_delta > 0), F.lit(False)
    )


def vector_promoted(validation_delta: Column, target_delta: Column, invalid: Column) -> Column:
    return (validation_delta >= 0) & (target_delta > 0) & (invalid == 0)


def final_vector_promoted(pixel_gate: Column, vector_gate: Column, final_delta: Column, invalid: Column,
                          overlap_before: Column, overlap_after: Column,
                          align_before: Column, align_after: Column) -> Column:
    return (
        F.coalesce(pixel_gate, F.lit(False)) & F.coalesce(vector_gate, F.lit(False))
        & (final_delta > 0) & (invalid == 0)
        & (overlap_after <= overlap_before) & (align_after >= align_before)
    )


def deployment_gate(valid: Column, align_before: Column, align_after: Column,
                    overlap_before: Column, overlap_after: Column) -> Column:
    """Keep the candidate only when it is valid, no less aligned and no more overlapping."""
    return valid & (align_after >= align_before) & (overlap_after <= overlap_before + 1e-8)


def area_difference(current: Column, old: Column) -> Column:
    return current - old


def area_difference_percent(current: Column, old: Column) -> Column:
    return F.when(old != 0, 100.0 * (current - old) / old)
