"""Import jobs: plain parcel features and refined payloads, each one plan with several outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.geometry import map_points, polygon_area
from ..functions.once import computed_once
from ..functions.projection import equal_area
from ..operators.contracts import import_rows
from ..operators.overlay import intersection_area, symmetric_difference_area, union_area

# Evidence components and texts of a refined payload.
SEGMENTATION_TEXT = "Calibrated SegFormer boundary-probability alignment stored by the selected vectorization run."
TOPOLOGY_TEXT = "Topology score reported after validity and overlap rejection gates."
ALIGNMENT_TEXT = "Refined boundary alignment with local raster edge evidence."


@dataclass
class ImportOutputs:
    parcels: DataFrame
    versions: DataFrame
    evidence: DataFrame
    anomalies: DataFrame
    queue: DataFrame


def _lower(flag: Column) -> Column:
    return F.when(flag, "true").otherwise("false")


def evidence_items(discrepancy: Column) -> Column:
    """Five evidence rows of a payload: component, score, text."""
    def item(component: str, score: Column, text: Column) -> Column:
        return F.struct(F.lit(component).alias("component"), score.alias("score"), text.alias("explanation"))

    refinement = F.concat(
        F.lit("PPO policy "), F.substring("policy_sha256", 1, 12), F.lit(" ran for "),
        F.format_number("timesteps", 0), F.lit(" timesteps; candidate accepted="), _lower(F.col("accepted")),
        F.lit(", changed="), _lower(F.col("changed")), F.lit(". "), F.col("explanation"))
    return F.array(
        item("segmentation", F.col("segmentation_score"), F.lit(SEGMENTATION_TEXT)),
        item("topology", F.col("topology_score"), F.lit(TOPOLOGY_TEXT)),
        item("edge_alignment", F.col("edge_alignment_score"), F.lit(ALIGNMENT_TEXT)),
        item("deviation_from_baseline", F.col("deviation_from_baseline_score"), F.concat(
            F.lit("Baseline agreement; measured discrepancy="), F.format_string("%.4f", discrepancy), F.lit("."))),
        item("rl_refinement", F.col("edge_alignment_score"), refinement),
    )


def score_payload(payload: DataFrame, lonlat: bool = True) -> DataFrame:
    """Payload rows with areas, discrepancy, volatility, health, anomalies, priority and reason.

    ``payload``: project_id, id, rings, baseline_rings and the payload columns.
    Areas and differences are taken on equal-area axes for lon/lat input.
    """
    flat = payload
    if lonlat:
        flat = computed_once(flat, _cur=map_points("rings", equal_area), _old=map_points("baseline_rings", equal_area))
    else:
        flat = flat.withColumn("_cur", F.col("rings")).withColumn("_old", F.col("baseline_rings"))
    sized = computed_once(flat, area_sqm=polygon_area("_cur"), _old_area=polygon_area("_old"))
    both = intersection_area(sized, ["id"], "_cur", "_old", carry=["area_sqm", "_old_area"])
    cur, old, inter = F.col("area_sqm"), F.col("_old_area"), F.col("inter_area")
    difference, union = symmetric_difference_area(cur, old, inter), union_area(cur, old, inter)
    ratio = S.capped_ratio(cur, old)
    share = F.least(F.lit(1.0), difference / F.when(union == 0, 1.0).otherwise(union))
    measured = both.select("id", "area_sqm", ratio.alias("volatility"), F.least(
        F.lit(1.0), 0.4 * ratio + 0.6 * share).alias("discrepancy"))
    rows = payload.join(measured, "id")
    violation = F.col("topology_score") < S.TOPOLOGY_SCORE_LIMIT
    c, d, v = F.col("confidence_score"), F.col("discrepancy"), F.col("volatility")
    found = S.anomalies(c, d, violation, v, 1.0 - F.col("topology_score"))
    scored = computed_once(rows, topology_violation=violation, anomalies=found)
    t, n = F.col("topology_violation"), F.size("anomalies")
    return (
        scored.withColumn("health_score", S.health_score(c, t, d, v))
        .withColumn("priority_score", S.priority_score(c, d, v, n, t))
        .withColumn("reason", S.priority_reason(c, d, v, n, t))
        .withColumn("status", F.when(c >= S.HIGH_MIN, "ai_processed").otherwise("needs_review"))
    )


def import_payload(payload: DataFrame, captured_at: Column, lonlat: bool = True) -> ImportOutputs:
    """Five tables of one import, as plans (``jobs.import_job`` writes them from one scoring pass)."""
    return import_outputs(score_payload(payload, lonlat), captured_at)


def import_outputs(s: DataFrame, captured_at: Column) -> ImportOutputs:
    """The five tables of scored payload rows."""
    return ImportOutputs(
        parcels=s.select(
            "id", "project_id", "rings", F.lit("ai_extracted").alias("source"), "status", "confidence_score",
            "health_score", F.lit(None).cast("string").alias("land_use"), "area_sqm", F.lit(1).alias("version")),
        versions=s.select(
            F.col("id").alias("parcel_id"), F.col("baseline_rings").alias("rings"), captured_at.alias("captured_at"),
            F.lit("vectorization_before_rl").alias("source")),
        evidence=s.select(F.col("id").alias("parcel_id"), F.explode(evidence_items(F.col("discrepancy"))).alias("_e")).select(
            "parcel_id", "_e.*"),
        anomalies=s.select(F.col("id").alias("parcel_id"), F.explode("anomalies").alias("_a")).select(
            "parcel_id", "_a.type", "_a.magnitude"),
        queue=s.select(
            F.col("id").alias("parcel_id"), "priority_score", "reason", F.lit("pending").alias("status")),
    )


def import_features(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parcels, evidence, refused) of plain parcel features.

    ``features``: id, project_id, rings and the segmentation columns; only the
    class ``parcel`` is imported.
    """
    from ..functions.projection import geodesic_area

    refused = features.where(F.col("class") != "parcel").select("id", F.lit("parcel_class_only").alias("rule"))
    rows = import_rows(features.where(F.col("class") == "parcel"))
    parcels = computed_once(rows.select("id", "project_id", "rings", "source", "status"), area_sqm=geodesic_area("rings"))
    evidence = rows.where(F.col("evidence_score").isNotNull()).select(
        F.col("id").alias("parcel_id"), F.lit("segmentation").alias("component"),
        F.col("evidence_score").alias("score"), F.col("evidence_text").alias("explanation"))
    return parcels, evidence, refused
