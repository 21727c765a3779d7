"""Readers of exchanged JSON documents, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.geometry import from_coordinates
from ..functions.identity import canonical_uuid
from ..functions.multipart import parts_from_geojson


def read_table(spark: SparkSession, root: str, name: str, project_id: str | None = None) -> DataFrame:
    """Stored table; a project filter prunes partitions where the table is partitioned by project."""
    df = spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")
    return df if project_id is None else df.where(F.col("project_id") == project_id)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: type, geometry, rings and the open properties as JSON text.

    Both a whole document and newline-delimited features are read; the number
    of features is not limited.
    """
    docs = spark.read.schema(schemas.FEATURE_COLLECTION).json(path, multiLine=True)
    rows = docs.select(
        F.col("type").alias("collection_type"), "schema_version", F.posexplode("features").alias("position", "f"))
    return _feature_columns(rows)


def multipart_columns(features: DataFrame) -> DataFrame:
    """``geometry`` as GeoJSON text becomes ``geometry_type`` and ``parts``; other columns stay."""
    kept = [c for c in features.columns if c != "geometry"]
    return features.select(*kept, F.get_json_object("geometry", "$.type").alias("geometry_type"), parts_from_geojson("geometry").alias("parts"))


def read_multipart_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of Polygon or MultiPolygon geometry, one per line: ``feature_type, properties, geometry_type, parts``."""
    rows = spark.read.schema("type string, geometry string, properties string").json(path)
    return multipart_columns(rows.withColumnRenamed("type", "feature_type"))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line: splittable, the form the sinks write."""
    schema = f"type string, geometry {schemas.POLYGON}, properties string"
    rows = spark.read.schema(schema).json(path).select(F.struct("type", "geometry", "properties").alias("f"))
    return _feature_columns(rows)


def _feature_columns(rows: DataFrame) -> DataFrame:
    kept = [c for c in rows.columns if c != "f"]
    return rows.select(
        *kept, F.col("f.type").alias("feature_type"), F.col("f.geometry").alias("geometry"),
        from_coordinates("f.geometry.coordinates").alias("rings"), F.col("f.properties").alias("properties"))


def segmentation_columns(features: DataFrame) -> DataFrame:
    """Known properties of a segmentation feature; ``class`` defaults to parcel.

    ``raw_confidence`` keeps its JSON spelling so that only numbers count.
    """
    def prop(name: str):
        return F.get_json_object("properties", f"$.{name}")

    typed = F.from_json("properties", "map<string,string>")
    return features.withColumn("class", F.coalesce(prop("class"), F.lit("parcel"))).withColumn(
        "has_raw_confidence", F.coalesce(F.map_contains_key(typed, F.lit("raw_confidence")), F.lit(False))
    ).withColumn("raw_confidence", F.when(
        # the property's own type decides, wherever else the name occurs
        F.expr("schema_of_variant(try_variant_get(try_parse_json(properties), '$.raw_confidence', 'variant'))").rlike(
            "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), prop("raw_confidence"))
    ).withColumn("source_tile_id", prop("source_tile_id")).withColumn("parcel_id", prop("parcel_id"))


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Refined-parcel records with canonical id, rings and baseline rings."""
    rows = spark.read.schema(schemas.PAYLOAD).json(path, multiLine=True)
    return rows.select(
        "*", canonical_uuid(F.col("parcel_id")).alias("id"),
        from_coordinates("geometry.coordinates").alias("rings"),
        from_coordinates("metadata.baseline_geometry.coordinates").alias("baseline_rings"),
        F.col("metadata.policy_sha256").alias("policy_sha256"), F.col("metadata.timesteps").alias("timesteps"),
        F.col("metadata.accepted").alias("accepted"), F.col("metadata.changed").alias("changed"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest row per file, its records); a manifest without records is its own single record."""
    docs = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True).withColumn("manifest", F.input_file_name())
    fields = {"name", "image", "crs", "transform", "bounds", "shape"}
    record_fields = spark.createDataFrame([], f"r {schemas.RECORD}").schema["r"].dataType
    own = F.struct(*[
        (F.col(f.name) if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in record_fields.fields])
    listed = F.when(F.col("records").isNotNull(), F.col("records")).when(F.col("image").isNotNull(), F.array(own))
    records = docs.select("manifest", F.posexplode(listed).alias("position", "r")).select("manifest", "position", "r.*")
    head = docs.select(
        "manifest", "version", "target_aoi_used_for_parameter_selection", "target_aoi_used_for_test",
        "target_aoi_used_for_training_or_selection",
        F.col("review_summary.training_ready").alias("review_training_ready"),
        F.col("matched_review_summary.training_ready").alias("matched_training_ready"))
    return head, records


def read_report(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Metric report (comparison, refinement, calibration, training), one row per file."""
    return spark.read.schema(schemas.REPORTS[kind]).json(path, multiLine=True)


def osm_features(elements: DataFrame) -> DataFrame:
    """Landed map elements -> ``osm_id, feature_type, line``: closed buildings, roads, canals; others drop.

    ``elements`` has ``id, tags, geometry`` (list of lat/lon).
    """
    line = F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    first, last = F.col("geometry")[0], F.try_element_at("geometry", F.lit(-1))
    closed = (F.size("geometry") >= 4) & (first == last)

    def tagged(name: str):
        return F.coalesce(F.map_contains_key("tags", F.lit(name)), F.lit(False))

    kind = F.when(tagged("building") & closed, "building").when(tagged("highway"), "road").when(tagged("waterway"), "canal")
    return elements.where(F.size("geometry") >= 2).select(
        F.col("id").alias("osm_id"), kind.alias("feature_type"), line.alias("line")
    ).where(F.col("feature_type").isNotNull())


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(schemas.OSM).json(path, multiLine=True)
    return osm_features(docs.select(F.explode("elements").alias("e")).select("e.id", "e.tags", "e.geometry"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
