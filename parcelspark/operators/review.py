"""Review decisions: outcomes, label export, coverage, matching to imagery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import geojson_geometry
from .skew import latest_by

# False-positive corrections and coverage minimums.
FALSE_POSITIVES = {
    "reject_building": "building", "reject_road": "road", "reject_canal": "canal", "reject_other": "other",
}
MINIMUMS = {"total": 100, "positive_boundaries": 40, "hard_negatives": 40}
CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"


def stored_correction_type(kind: Column, label: Column) -> Column:
    """``reject`` with a label becomes ``reject_<class>``."""
    return F.when(
        (kind == "reject") & label.isNotNull(),
        F.concat(F.lit("reject_"), F.regexp_replace(label, "^false_positive_", "")),
    ).otherwise(kind)


def latest_correction(corrections: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Newest correction per parcel; a missing time counts as the epoch, the later id wins a tie."""
    timed = corrections.withColumn("_at", F.coalesce(F.unix_micros("created_at"), F.lit(0)))
    return latest_by(timed, ["parcel_id"], ["_at", "correction_id"], keep or ["correction_id", "correction_type", "created_at"])


def evidence_map(evidence: DataFrame) -> DataFrame:
    """``parcel_id, evidence``: component -> newest score; at most one entry per component."""
    newest = latest_by(evidence, ["parcel_id", "component"], ["created_at", "batch", "line", "score"], ["score"])
    entries = F.sort_array(F.collect_list(F.struct("component", "score")))
    return newest.groupBy("parcel_id").agg(F.map_from_entries(entries).alias("evidence"))


def review_outcomes(parcels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every parcel with its outcome, training role and class; null roles are not eligible."""
    joined = parcels.join(latest_correction(corrections), "parcel_id", "left")
    kind = F.col("correction_type")
    classes = F.create_map(*[F.lit(v) for pair in FALSE_POSITIVES.items() for v in pair])
    positive = (F.col("status") == "verified") & ~kind.startswith("reject")
    negative = (F.col("status") == "rejected") & kind.isin(*FALSE_POSITIVES)
    return (
        joined.withColumn("review_outcome", F.when(positive, "verified_boundary").when(negative, "false_positive"))
        .withColumn("training_role", F.when(positive, "positive_boundary").when(negative, "hard_negative"))
        .withColumn("false_positive_class", F.when(negative, classes[kind]))
        .withColumn("rejected_without_label", (F.col("status") == "rejected") & kind.isNotNull() & ~negative)
    )


def ready(total: Column, positives: Column, negatives: Column, minimums: dict = MINIMUMS) -> Column:
    return (
        (total >= minimums["total"]) & (positives >= minimums["positive_boundaries"])
        & (negatives >= minimums["hard_negatives"])
    )


def export_summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per project: eligible labels, roles, classes, rejected without label, readiness."""
    agg = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("project_parcels"),
        F.count("training_role").alias("eligible_reviewed_labels"),
        F.count_if(F.col("training_role") == "positive_boundary").alias("positive_boundaries"),
        F.count_if(F.col("training_role") == "hard_negative").alias("hard_negatives"),
        *[F.count_if(F.col("false_positive_class") == c).alias(f"class_{c}") for c in FALSE_POSITIVES.values()],
        F.count_if("rejected_without_label").alias("rejected_without_specific_label"),
    )
    classes = sorted(FALSE_POSITIVES.values())
    counted = F.map_filter(
        F.create_map(*[c for n in classes for c in (F.lit(n), F.col(f"class_{n}"))]), lambda k, v: v > 0)
    return (
        agg.withColumn("false_positive_classes", counted).drop(*[f"class_{c}" for c in classes])
        .withColumn("unreviewed_or_ineligible", F.col("project_parcels") - F.col("eligible_reviewed_labels"))
        .withColumn("training_ready", ready(
            F.col("eligible_reviewed_labels"), F.col("positive_boundaries"), F.col("hard_negatives")))
    )


def export_features(outcomes: DataFrame, layer: DataFrame, evidence: DataFrame) -> DataFrame:
    """Eligible labels as GeoJSON features: ``project_id, feature`` (JSON text, one per row)."""
    eligible = outcomes.where(F.col("training_role").isNotNull())
    shaped = eligible.join(layer.select(F.col("id").alias("parcel_id"), "rings"), "parcel_id").join(
        evidence_map(evidence), "parcel_id", "left")
    properties = F.struct(
        F.col("parcel_id").cast("string").alias("parcel_id"), F.col("project_id").cast("string").alias("project_id"),
        "review_outcome", "training_role", "false_positive_class", "correction_type",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("reviewed_at"),
        F.coalesce("version", F.lit(1)).alias("parcel_version"), "source",
        F.col("confidence").alias("confidence_score"), F.col("health").alias("health_score"),
        F.coalesce("evidence", F.create_map().cast("map<string,double>")).alias("evidence"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), geojson_geometry("rings").alias("geometry"), properties.alias("properties"))
    return shaped.select("project_id", "parcel_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def combined_labels(base: DataFrame, feedback: DataFrame) -> DataFrame:
    """Base records followed by feedback records; missing columns become null."""
    return base.unionByName(feedback, allowMissingColumns=True)


def unmatched_ids(reviewed: DataFrame, matched: DataFrame) -> DataFrame:
    return reviewed.join(matched, "parcel_id", "left_anti").select("parcel_id").orderBy("parcel_id")
