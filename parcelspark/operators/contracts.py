"""Input contracts as violation rows: ``id, rule`` for every broken rule of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import equals_exact
from ..functions.identity import canonical_uuid
from .skew import rows_not_listed
from .validity import invalid_reason

SCORES = ["confidence_score", "segmentation_score", "topology_score", "edge_alignment_score",
          "deviation_from_baseline_score"]
ROLES = ("positive_boundary", "hard_negative")
NEGATIVE_CLASSES = ("building", "road", "canal", "other")
SEGMENTATION_CLASSES = ("parcel", "building", "road", "land_use")


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """``keys, rule``: one row per rule whose condition holds (null counts as not broken)."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(*keys, F.explode(found).alias("rule"))


def missing(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).isNull()


def outside(c: str, low: float, high: float) -> Column:
    return ~F.col(c).between(low, high) | F.isnan(F.col(c))


def polygon_rules(geometry_type: Column, coordinates: Column, rings: Column) -> dict[str, Column]:
    """Structure of a GeoJSON polygon in lon/lat, then validity for those that pass."""
    nonempty = (geometry_type == "Polygon") & coordinates.isNotNull() & (F.size(coordinates) > 0)
    short = F.exists(coordinates, lambda r: F.size(r) < 4)
    unclosed = F.exists(coordinates, lambda r: (F.size(r) > 0) & (r[0] != F.element_at(r, -1)))
    not_2d = F.exists(coordinates, lambda r: F.exists(r, lambda p: F.size(p) != 2))
    off_globe = F.exists(coordinates, lambda r: F.exists(
        r, lambda p: ~p[0].between(-180, 180) | ~p[1].between(-90, 90)))
    structure_ok = nonempty & ~short & ~unclosed & ~not_2d
    return {
        "polygon_required": ~F.coalesce(nonempty, F.lit(False)),
        "ring_positions": nonempty & short,
        "ring_closed": nonempty & unclosed,
        "position_2d": nonempty & not_2d,
        "lon_lat_range": structure_ok & off_globe,
        "polygon_valid": structure_ok & F.when(structure_ok, invalid_reason(rings)).isNotNull(),
    }


def displayable(geometry_type: Column, coordinates: Column) -> Column:
    """Polygon with at least one ring of four positions."""
    return F.coalesce(
        (geometry_type == "Polygon") & F.exists(coordinates, lambda r: F.size(r) >= 4), F.lit(False))


def payload_rules() -> dict[str, Column]:
    """Range rules of a refined-parcel record."""
    rules = {f"{s}_range": outside(s, 0, 1) for s in SCORES}
    rules.update({f"{s}_missing": missing(s) for s in SCORES})
    rules.update({
        "parcel_id_uuid": canonical_uuid(F.col("parcel_id")).isNull(),
        "policy_sha256_length": F.coalesce(F.length("policy_sha256") != 64, F.lit(True)),
        "timesteps_positive": F.coalesce(F.col("timesteps") <= 0, F.lit(True)),
        "explanation_length": F.coalesce(~F.length("explanation").between(1, 4000), F.lit(True)),
        "demo_refused": F.coalesce("demo", F.lit(False)),
    })
    return rules


def duplicates(df: DataFrame, key: Column, name: str = "id") -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def import_rows(features: DataFrame) -> DataFrame:
    """Source and status of imported features, and the segmentation evidence they bring.

    ``raw_confidence`` is the JSON text of the property (null when absent), so
    text and booleans are told apart from numbers.
    """
    number = F.when(F.col("raw_confidence").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), F.col("raw_confidence").cast("double"))
    tile = F.substring(F.coalesce("source_tile_id", F.lit("unreported")), 1, 200)
    has = number.between(0, 1)
    return features.withColumn(
        "source", F.when(F.col("has_raw_confidence"), "ai_extracted").otherwise("existing_gis")
    ).withColumn("status", F.lit("needs_review")).withColumn(
        "evidence_score", F.when(has, number)
    ).withColumn("evidence_text", F.when(has, F.concat(
        F.lit("Imported raw segmentation confidence from tile "), tile,
        F.lit(". This is not boundary confidence or proof of RL execution."))))


def companion_report(features: DataFrame, payload: DataFrame, shown: int = 10) -> DataFrame:
    """``kind, id`` rows where a display layer and its payload disagree.

    Kinds: missing_metadata, missing_geometry, geometry_mismatch. Both sides
    have ``id`` (canonical) and ``rings``. ``shown`` ids per missing kind are
    what an error message lists; see :func:`first_ids`.
    """
    joined = features.select("id", F.col("rings").alias("a"), F.lit(True).alias("_f")).join(
        payload.select("id", F.col("rings").alias("b"), F.lit(True).alias("_p")), "id", "full_outer")
    kind = (
        F.when(F.col("_p").isNull(), "missing_metadata")
        .when(F.col("_f").isNull(), "missing_geometry")
        .when(~equals_exact("a", "b", 1e-12), "geometry_mismatch")
    )
    return joined.select(kind.alias("kind"), "id").where(F.col("kind").isNotNull())


def first_ids(report: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """First ``n`` ids of a kind in order, for a message."""
    return report.where(F.col("kind") == kind).orderBy("id").limit(n)


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``side, key``: keys found on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left_only").alias("side"), key).unionByName(
        b.join(a, key, "left_anti").select(F.lit("right_only").alias("side"), key))


def occupied_projects(incoming: DataFrame, parcels: DataFrame) -> DataFrame:
    """Target projects that already hold parcels, and incoming parcels already stored."""
    held = parcels.select("project_id").distinct()
    busy = incoming.select("project_id").distinct().join(held, "project_id", "left_semi").select(
        F.lit("project_not_empty").alias("rule"), F.col("project_id").cast("string").alias("id"))
    stored = incoming.select("parcel_id").join(parcels, "parcel_id", "left_semi").select(
        F.lit("parcel_stored").alias("rule"), F.col("parcel_id").cast("string").alias("id"))
    return busy.unionByName(stored)


def unknown_assignees(queue: DataFrame, users: DataFrame) -> DataFrame:
    """Queue rows whose assignee is not a user."""
    asked = queue.where(F.col("assigned_to").isNotNull())
    return rows_not_listed(asked, users.select(F.col("user_id").alias("assigned_to")), ["assigned_to"], spread=["queue_id"])


def review_export_rules() -> dict[str, Column]:
    """Feature rules of a label export."""
    role = F.col("training_role")
    return {
        "parcel_id_missing": missing("parcel_id"),
        "role_unsupported": ~F.coalesce(role.isin(*ROLES), F.lit(False)),
        "negative_without_class": (role == "hard_negative")
        & ~F.coalesce(F.col("false_positive_class").isin(*NEGATIVE_CLASSES), F.lit(False)),
    }


def review_export_violations(header: DataFrame, features: DataFrame, schema_version: str) -> DataFrame:
    """``id, rule`` rows of an export: header, features and duplicate ids."""
    head = violations(header, [F.lit("document").alias("id")], {
        "schema_version": F.coalesce(F.col("schema_version") != schema_version, F.lit(True)),
        "feature_collection": F.coalesce(F.col("type") != "FeatureCollection", F.lit(True)),
    })
    each = violations(features, [F.col("parcel_id").cast("string").alias("id")], review_export_rules())
    twice = duplicates(features, F.col("parcel_id").cast("string")).select("id", F.lit("duplicate_id").alias("rule"))
    return head.unionByName(each).unionByName(twice)


def segmentation_rules() -> dict[str, Column]:
    """Hand-off rules of a segmentation feature."""
    return {
        "class_enum": ~F.coalesce(F.col("class").isin(*SEGMENTATION_CLASSES), F.lit(False)),
        "raw_confidence_range": F.coalesce(outside("raw_confidence", 0, 1), F.lit(True)),
        "source_tile_id_missing": missing("source_tile_id"),
        "parcel_id_missing": (F.col("class") == "parcel") & missing("parcel_id"),
    }


def parcel_response_rules() -> dict[str, Column]:
    """Enumerations and ranges of a stored parcel."""
    return {
        "status_enum": ~F.col("status").isin("ai_processed", "needs_review", "verified", "rejected"),
        "source_enum": ~F.col("source").isin("ai_extracted", "existing_gis", "field_verified"),
        "confidence_range": outside("confidence", 0, 1),
        "health_range": outside("health", 0, 1),
        "version_positive": F.col("version") < 1,
    }


def feature_rules() -> dict[str, Column]:
    """A served parcel feature: ``feature`` is its GeoJSON text."""
    text = F.col("feature")

    def at(path: str) -> Column:
        return F.get_json_object(text, f"$.{path}")

    p = "properties"
    number = lambda name: at(f"{p}.{name}").try_cast("double")
    return {
        "feature_type": at("type").isNull() | (at("type") != "Feature"),
        "geometry_type": at("geometry.type").isNull() | (at("geometry.type") != "Polygon"),
        "coordinates_missing": at("geometry.coordinates").isNull(),
        "id_uuid": canonical_uuid(at(f"{p}.id")).isNull(),
        "project_id_uuid": canonical_uuid(at(f"{p}.project_id")).isNull(),
        "source_enum": ~F.coalesce(at(f"{p}.source").isin("ai_extracted", "existing_gis", "field_verified"), F.lit(False)),
        "status_enum": ~F.coalesce(at(f"{p}.status").isin("ai_processed", "needs_review", "verified", "rejected"), F.lit(False)),
        "confidence_range": (number("confidence_score") < 0) | (number("confidence_score") > 1),
        "health_range": (number("health_score") < 0) | (number("health_score") > 1),
        "version_positive": number("version") < 1,
    }


def explanation_rules() -> dict[str, Column]:
    """An explanation response: parcel_id, explanation and components (component, score, explanation)."""
    return {
        "parcel_id_uuid": canonical_uuid(F.col("parcel_id")).isNull(),
        "explanation_missing": F.col("explanation").isNull(),
        "components_missing": F.col("components").isNull(),
        "component_enum": F.exists("components", lambda c: ~F.coalesce(
            c["component"].isin("segmentation", "topology", "edge_alignment", "deviation_from_baseline"), F.lit(False))),
        "component_score_range": F.exists("components", lambda c: F.coalesce((c["score"] < 0) | (c["score"] > 1), F.lit(True))),
        "component_text_missing": F.exists("components", lambda c: c["explanation"].isNull()),
    }


def queue_rules() -> dict[str, Column]:
    return {
        "queue_status_enum": ~F.col("status").isin("pending", "assigned", "completed"),
        "priority_range": outside("priority_score", 0, 1),
        "assigned_without_user": (F.col("status") == "assigned") & missing("assigned_to"),
    }


def grid_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rasters whose grid (affine, CRS, shape) differs between two grid tables, or is missing in one."""
    fields = ["a", "b", "c", "d", "e", "f", "crs", "height", "width"]
    left = a.select("raster_id", F.struct(*fields).alias("_l"))
    right = b.select("raster_id", F.struct(*fields).alias("_r"))
    return left.join(right, "raster_id", "full_outer").where(~F.col("_l").eqNullSafe(F.col("_r"))).select(
        "raster_id", F.when(F.col("_l").isNull() | F.col("_r").isNull(), "missing").otherwise("grid_differs").alias("rule"))


def output_consistency(candidates: DataFrame, refined: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row of checks over an output set: equal counts, aligned and unique ids, scores and validity.

    Each input has ``position, parcel_id, rings``; payloads also the scores.
    """
    pay = payloads.withColumn("_ok_scores", ~sum(
        [F.coalesce(outside(s, 0, 1), F.lit(True)).cast("int") for s in SCORES[1:]],
        F.coalesce(outside(SCORES[0], 0, 1), F.lit(True)).cast("int")).cast("boolean"))
    joined = (
        candidates.select("position", F.lit(1).alias("_c"))
        .join(refined.select("position", F.col("parcel_id").alias("_rid"), F.col("rings").alias("_rr")), "position", "full_outer")
        .join(pay.select("position", F.col("parcel_id").alias("_pid"), F.col("rings").alias("_pr"), "_ok_scores"),
              "position", "full_outer")
    )
    ids = payloads.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.max("_n"), F.lit(0)).alias("_most"), F.count(F.lit(1)).alias("unique_parcel_ids"))
    checks = joined.agg(
        F.count("_c").alias("parcel_count"),
        F.bool_and(F.col("_c").isNotNull() & F.col("_rid").isNotNull() & F.col("_pid").isNotNull()).alias("counts_equal"),
        F.bool_and(F.coalesce(F.col("_rid") == F.col("_pid"), F.lit(False))).alias("ids_aligned"),
        F.bool_and(F.coalesce("_ok_scores", F.lit(False))).alias("scores_in_range"),
        F.bool_and(invalid_reason("_rr").isNull() & invalid_reason("_pr").isNull()).alias("all_valid"),
    )
    return checks.withColumn("_k", F.lit(1)).join(ids.withColumn("_k", F.lit(1)), "_k").withColumn(
        "ids_unique", F.col("_most") <= 1).drop("_k", "_most")
