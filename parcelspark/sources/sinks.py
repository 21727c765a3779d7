"""Writers: GeoJSON features, review-label documents, versioned outputs, record snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import geojson_geometry
from ..functions.multipart import geojson_of_parts

CRS84 = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}


def feature_rows(layer: DataFrame, properties: list[str], rings: str = "rings") -> DataFrame:
    """One GeoJSON Feature per row, as text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        geojson_geometry(rings).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return layer.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def multipart_rows(layer: DataFrame, properties: list[str], parts: str = "parts") -> DataFrame:
    """One GeoJSON Feature per row, as text; a single part is a Polygon, several are a MultiPolygon."""
    text = F.concat(
        F.lit('{"type":"Feature","geometry":'), geojson_of_parts(parts), F.lit(',"properties":'),
        F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}), F.lit("}"))
    return layer.select(text.alias("value"))


def write_features(features: DataFrame, path: str, header: dict | None = None, mode: str = "errorifexists") -> None:
    """Features as newline-delimited text in parallel, the document header beside them.

    An empty layer still gets its header, so readers see a valid empty collection.
    """
    features.select("value").write.mode(mode).text(f"{path}/features")
    document = {"type": "FeatureCollection", "crs": CRS84, **(header or {})}
    spark = features.sparkSession
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/header")


def review_label_header(project: dict, summary: dict, schema_version: str, generated_at: str) -> dict:
    """Header of a label export: project, summary, coverage; features are written beside it."""
    return {
        "schema_version": schema_version,
        "name": f"{project['name']} reviewed parcel feedback",
        "generated_at": generated_at,
        "project": project,
        "summary": summary,
    }


def write_versioned(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None) -> str:
    """Parquet under ``root/version=<v>``; an existing version is never overwritten."""
    path = f"{root}/version={version}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def snapshot_rows(projects: DataFrame, parcels: DataFrame, queue: DataFrame) -> DataFrame:
    """``kind, record``: every stored record as JSON text, tagged with its table."""
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("record"))

    return tagged(projects, "projects").unionByName(tagged(parcels, "parcels")).unionByName(tagged(queue, "queue"))


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").partitionBy("kind").text(path)


def feature_id(column: Column) -> Column:
    return column.cast("string")
