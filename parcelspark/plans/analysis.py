"""Whole-layer parcel analysis: topology, volatility, discrepancy, health, anomalies, priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators.history import historical_volatility, latest_discrepancy
from ..operators.topology import topology_violation


def analyze_layer(parcels: DataFrame, layer: DataFrame, versions: DataFrame, version_shapes: DataFrame) -> DataFrame:
    """One row per parcel with every score; nothing is looked up parcel by parcel."""
    violation = topology_violation(layer, ["project_id"])
    volatility = historical_volatility(versions)
    shift = latest_discrepancy(layer.select("id", "rings"), version_shapes)
    joined = (
        parcels.select("parcel_id", "project_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
        .join(violation.select(F.col("id").alias("parcel_id"), "topology_violation"), "parcel_id", "left")
        .join(volatility, "parcel_id", "left")
        .join(shift.select(F.col("id").alias("parcel_id"), "normalized_discrepancy", "centroid_shift_m"), "parcel_id", "left")
        .fillna({"volatility": 0.0, "normalized_discrepancy": 0.0, "topology_violation": False})
    )
    return score_rows(joined)


def score_rows(rows: DataFrame) -> DataFrame:
    """Scores from ``confidence, normalized_discrepancy, topology_violation, volatility``."""
    c, d, t, v = (F.col(n) for n in ("confidence", "normalized_discrepancy", "topology_violation", "volatility"))
    scored = rows.withColumn("health_score", S.health_score(c, t, d, v)).withColumn(
        "anomalies", S.anomalies(c, d, t, v))
    n = F.size("anomalies")
    return (
        scored.withColumn("health_band", S.health_band(F.col("health_score")))
        .withColumn("anomaly_count", n)
        .withColumn("priority_score", S.priority_score(c, d, v, n, t))
        .withColumn("reason", S.priority_reason(c, d, v, n, t))
        .withColumn("health_explanation", S.health_text(F.col("health_score"), c, t, d, v))
    )


@dataclass
class AnalysisOutputs:
    health: DataFrame
    anomalies: DataFrame
    queue: DataFrame


def write_back(analysis: DataFrame, run_id: str) -> AnalysisOutputs:
    """The three tables an analysis run replaces; a repeated run id gives the same rows."""
    run = F.lit(run_id).alias("run_id")
    return AnalysisOutputs(
        health=analysis.select(run, "parcel_id", "health_score"),
        anomalies=analysis.select(run, "parcel_id", F.posexplode("anomalies").alias("rule", "a")).select(
            "run_id", "parcel_id", "rule", "a.type", "a.magnitude", "a.explanation"),
        queue=analysis.select(run, "parcel_id", "priority_score", "reason", F.lit("pending").alias("status")),
    )
