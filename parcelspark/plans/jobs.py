"""Write jobs: imports behind their guards and analysis runs, each one pass and one commit."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import contracts as K
from ..sources.commits import begin
from .analysis import analyze_layer, write_back
from .imports import ImportOutputs, import_outputs, score_payload


class ImportRefused(RuntimeError):
    """The guards found something; nothing was written."""

    def __init__(self, counts: dict[str, int]):
        super().__init__("; ".join(f"{rule}: {n}" for rule, n in sorted(counts.items())))
        self.counts = counts


def import_findings(payload: DataFrame, parcels: DataFrame, projects: DataFrame) -> DataFrame:
    """``rule, id`` of everything that forbids an import.

    Project not there or not empty, parcel already stored, ids that occur twice, scores missing or out of range.
    """
    keys = payload.select("project_id", F.col("id").alias("parcel_id"))
    unknown = keys.select("project_id").distinct().join(projects.select("project_id"), "project_id", "left_anti").select(
        F.lit("project_missing").alias("rule"), F.col("project_id").cast("string").alias("id"))
    twice = K.duplicates(payload, F.col("id")).select(F.lit("parcel_repeated").alias("rule"), F.col("id").cast("string").alias("id"))
    rules = {f"{s}_range": K.outside(s, 0, 1) for s in K.SCORES} | {f"{s}_missing": K.missing(s) for s in K.SCORES}
    broken = K.violations(payload, [F.col("id").cast("string").alias("id")], rules).select("rule", "id")
    return K.occupied_projects(keys, parcels).unionByName(unknown).unionByName(twice).unionByName(broken)


def import_job(
    payload: DataFrame, parcels: DataFrame, projects: DataFrame, root: str, version: str, captured_at: Column, lonlat: bool = True
) -> None:
    """Import a payload as one version of five tables, or nothing.

    The guards come first. Scores are computed and written once; the five tables are projections of those rows.
    """
    attempt = begin(payload.sparkSession, root, version)
    counts = {r["rule"]: r["n"] for r in import_findings(payload, parcels, projects).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row per rule
    if counts:
        raise ImportRefused(counts)
    scored = attempt.write("_scored", score_payload(payload, lonlat))
    out = import_outputs(scored, captured_at)
    names = [f.name for f in fields(ImportOutputs)]
    for name in names:
        attempt.write(name, getattr(out, name))
    attempt.commit(names)


def analysis_job(
    parcels: DataFrame, layer: DataFrame, versions: DataFrame, version_shapes: DataFrame, root: str, run_id: str
) -> None:
    """Analyse a layer once and commit health, anomalies and queue of the run together.

    A run id is written once: a repeated run is refused, so no anomaly or queue row appears twice.
    """
    attempt = begin(parcels.sparkSession, root, run_id)
    analysis = attempt.write("analysis", analyze_layer(parcels, layer, versions, version_shapes))
    out = write_back(analysis, run_id)
    for name in ("health", "anomalies", "queue"):
        attempt.write(name, getattr(out, name))
    attempt.commit(["analysis", "health", "anomalies", "queue"])
