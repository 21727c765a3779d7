"""Training-set readiness: manifest contract, leakage, coverage, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..functions.once import computed_once
from ..session import cut_lineage
from .clipping import clip_parts
from .grid import cross_candidates, self_candidates
from .overlay import intersection_area
from .pixels import HARD_CLASSES, THIN_RATIO
from .review import combined_labels
from .skew import salted_lookup, shuffled
from .validity import invalid_reason

# Windows required per split, classes that must be covered.
REQUIRED_SPLITS = {"train": 9, "validation": 3, "test": 3}
REQUIRED_CLASSES = ("building", "canal", "road")
FEEDBACK = "human_review_feedback"
FLAGS = {
    "target_aoi_used_for_parameter_selection": "Manifest does not prove target-AOI exclusion from parameter selection.",
    "target_aoi_used_for_test": "Manifest does not prove target-AOI exclusion from testing.",
}
LEGACY_FLAG = "target_aoi_used_for_training_or_selection"


def split_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in REQUIRED_SPLITS],
        F.count_if(F.col("source") == FEEDBACK).alias("human_feedback_windows"),
        F.count_if((F.col("source") == FEEDBACK) & ~F.col("split").eqNullSafe(F.lit("train"))).alias("feedback_outside_train"),
        F.count(F.lit(1)).alias("records"),
    )


def manifest_findings(manifest: DataFrame, records: DataFrame, keys: list[str],
                      minimums: dict[str, int] = REQUIRED_SPLITS) -> DataFrame:
    """``keys, level, message``: blockers and warnings of the manifest itself.

    ``manifest`` has the flag columns (null when absent); a missing flag falls
    back to the older combined flag.
    """
    joined = manifest.join(split_counts(records, keys), keys, "left").fillna(
        0, [*REQUIRED_SPLITS, "human_feedback_windows", "feedback_outside_train", "records"])
    some = F.col("records") > 0

    def finding(level: str, cond, text) -> Column:
        message = F.lit(text) if isinstance(text, str) else text
        return F.when(cond, F.struct(F.lit(level).alias("level"), message.alias("message")))

    short = [
        finding("blocker", some & (F.col(s) < n), F.concat(
            F.lit(f"{s} needs at least {n} windows; found "), F.col(s).cast("string"), F.lit(".")))
        for s, n in minimums.items()
    ]
    flags = [
        finding("blocker", some & ~F.coalesce(F.coalesce(name, LEGACY_FLAG) == F.lit(False), F.lit(False)), text)
        for name, text in FLAGS.items()
    ]
    rest = [
        finding("blocker", ~some, "Manifest has no records."),
        finding("blocker", F.col("feedback_outside_train") > 0, "Human-review feedback appears outside the training split."),
        finding("warning", some & (F.col("human_feedback_windows") == 0),
                "No human-reviewed feedback windows are present; smoke testing may proceed on independent OSM negatives only."),
    ]
    return joined.select(*keys, F.explode(F.array_compact(F.array(*short, *flags, *rest))).alias("_f")).select(*keys, "_f.*")


def feedback_ready(matched: str = "matched_training_ready", review: str = "review_training_ready"):
    """Labels matched to imagery decide; the export's own summary only when there is no match summary."""
    return F.coalesce(F.col(matched), F.col(review), F.lit(False))


def boundary_coverage():
    """A record needs boundary pixels, unless it is a reviewed negative-only window."""
    return (F.col("boundary_pixels") > 0) | (
        (F.col("source") == FEEDBACK) & (F.coalesce("hard_negative_count", F.lit(0)) > 0) & (F.col("hard_pixels") > 0))


def record_findings(audited: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, name, message``: blockers of single records from their pixel audit."""
    covered = F.coalesce(boundary_coverage(), F.lit(False))
    name = F.col("name")
    checks = F.array_compact(F.array(
        F.when(~covered, F.concat(name, F.lit(" has neither rasterized cadastral boundaries nor explicit hard-negative evidence."))),
        F.when(F.col("boundary_ratio") > THIN_RATIO, F.concat(
            name, F.lit(" boundary mask is not thin ("), F.format_string("%.2f%%", F.col("boundary_ratio") * 100), F.lit(" of valid pixels)."))),
        F.when(F.col("conflict_pixels") > 0, F.concat(
            name, F.lit(" has "), F.col("conflict_pixels").cast("string"), F.lit(" boundary/hard-negative conflict pixels after protection."))),
    ))
    return audited.select(*keys, "name", F.explode(checks).alias("message"))


def split_leakage(windows: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, l_id, r_id, l_split, r_split``: windows of different splits whose boxes meet; with their names, if they have any."""
    carry = ["split", *(["name"] if "name" in windows.columns else [])]
    pairs = self_candidates(windows, scope, carry)
    return pairs.where(F.col("l_split") != F.col("r_split")).select(
        *scope, "l_id", "r_id", *[f"{side}_{c}" for c in carry for side in ("l", "r")])


def outside_target(windows: DataFrame, target: DataFrame) -> DataFrame:
    """Windows that touch no target area box (both: ``id`` and box columns).

    Only existence is asked: equal target boxes are one, and each window counts its hits before the shuffle, so
    no list of window and target pairs is made.
    """
    boxes = target.select("minx", "miny", "maxx", "maxy").distinct().withColumn("id", F.monotonically_increasing_id())
    hit = cross_candidates(windows, cut_lineage(boxes), [], [], []).groupBy(F.col("l_id").alias("id")).agg(F.lit(True).alias("_hit"))
    return windows.join(shuffled(hit), "id", "left_anti")


def readiness_messages(manifest: DataFrame, records: DataFrame, audited: DataFrame, leaks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, level, message``: every finding behind a report, as text; a manifest's rows are not gathered.

    ``leaks``: keys, l_name, l_split, r_name, r_split of windows of different splits that meet.
    """
    found = manifest_findings(manifest, records, keys).select(*keys, "level", "message")
    own = record_findings(audited, keys).select(*keys, F.lit("blocker").alias("level"), "message")
    spatial = leaks.select(*keys, F.lit("blocker").alias("level"), F.concat(
        F.lit("Spatial split leakage: "), "l_name", F.lit(" ("), "l_split", F.lit(") intersects "), "r_name", F.lit(" ("), "r_split", F.lit(").")).alias("message"))
    return found.unionByName(own).unionByName(spatial)


def merge_counts(records: DataFrame, keys: list[str], counts: str = "hard_negative_counts") -> DataFrame:
    """``keys, class, features``: per-class feature counts added over records."""
    return records.select(*keys, F.explode(counts).alias("class", "n")).groupBy(*keys, "class").agg(
        F.sum("n").alias("features"))


def class_counts(features: DataFrame, keys: list[str], kind: str = "feature_type") -> DataFrame:
    """``keys, class_counts``: map of class to count; entries are bounded by the class list."""
    counted = features.groupBy(*keys, F.col(kind).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("class_counts"))


def readiness_report(manifest: DataFrame, records: DataFrame, audited: DataFrame, leaks: DataFrame,
                     keys: list[str]) -> DataFrame:
    """One row per manifest: split counts, pixels per class, blocker counts and readiness flags."""
    found = manifest_findings(manifest, records, keys)
    levels = found.groupBy(*keys).agg(
        F.count_if(F.col("level") == "blocker").alias("_manifest_blockers"),
        F.count_if(F.col("level") == "warning").alias("warnings"))
    per_record = record_findings(audited, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_record_blockers"))
    pixels = audited.groupBy(*keys).agg(
        *[F.sum(f"{n}_pixels").alias(f"{n}_pixels") for n in HARD_CLASSES.values()])
    leaked = leaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_leaks"))
    out = (
        manifest.join(split_counts(records, keys), keys, "left").join(levels, keys, "left")
        .join(per_record, keys, "left").join(pixels, keys, "left").join(leaked, keys, "left")
    )
    counts = ["_manifest_blockers", "warnings", "_record_blockers", "_leaks", *REQUIRED_SPLITS,
              "human_feedback_windows", *[f"{n}_pixels" for n in HARD_CLASSES.values()]]
    out = out.fillna(0, counts)
    absent = F.array_compact(F.array(*[F.when(F.col(f"{c}_pixels") == 0, c) for c in REQUIRED_CLASSES]))
    blockers = (
        F.col("_manifest_blockers") + F.col("_record_blockers") + F.col("_leaks") + (F.size(absent) > 0).cast("int"))
    ready = feedback_ready()
    return out.select(
        *keys, *REQUIRED_SPLITS, *[f"{n}_pixels" for n in HARD_CLASSES.values()], "human_feedback_windows",
        (F.col("_leaks") == 0).alias("spatial_split_isolated"),
        F.array_join(absent, ", ").alias("missing_classes"),
        blockers.alias("blockers"),
        (F.col("warnings") + ((F.col("human_feedback_windows") > 0) & ~ready).cast("int")).alias("warnings"),
        (blockers == 0).alias("ready_for_smoke_test"),
        ((blockers == 0) & ready).alias("ready_for_heavy_training"),
    )


def first_image(features: DataFrame, images: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``scope, id, image_index``: each reviewed polygon goes to the first image it shares area with.

    ``features``: scope, id, rings, box; ``images``: scope, id (the index), rings, box.
    """
    scope = scope or []
    pairs = cross_candidates(features, images, scope, ["rings"], ["rings"])
    shared = intersection_area(pairs, [*scope, "l_id", "r_id"], "l_rings", "r_rings").where(F.col("inter_area") > 0)
    return shared.groupBy(*scope, F.col("l_id").alias("id")).agg(F.min("r_id").alias("image_index"))


def cropped_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``id, image, parts``: labels cut to the boxes of the images they reach.

    ``labels`` and ``images``: id, rings, box. A label may fall into several parts. Crops without an area are left
    out, and so are labels that are not valid themselves: a valid polygon cut to a box stays valid.
    """
    pairs = cross_candidates(labels, images, [], ["rings"], [])
    cut = computed_once(
        pairs, _why=invalid_reason("l_rings"), parts=clip_parts("l_rings", *[f"r_{c}" for c in ("minx", "miny", "maxx", "maxy")]))
    return cut.where(F.col("_why").isNull() & F.col("parts").isNotNull()).select(
        F.col("l_id").alias("id"), F.col("r_id").alias("image"), "parts")


def reference_faces(faces: DataFrame, windows: DataFrame, keys: list[str], inset: float = 5.0,
                    min_area: float = 20.0, max_area: float = 250_000.0) -> DataFrame:
    """Valid faces inside their window's inset box with an area between the limits (exclusive)."""
    from ..functions.geometry import with_bbox

    sized = computed_once(faces, area_m2=polygon_area("rings"), _why=invalid_reason("rings"))
    sized = sized.where(F.col("_why").isNull() & (F.col("area_m2") > min_area) & (F.col("area_m2") < max_area)).drop("_why")
    boxed = with_bbox(sized)
    frame = windows.select(*keys, *[F.col(b).alias(f"_w{b}") for b in ("minx", "miny", "maxx", "maxy")])
    inside = (
        (F.col("minx") >= F.col("_wminx") + inset) & (F.col("maxx") <= F.col("_wmaxx") - inset)
        & (F.col("miny") >= F.col("_wminy") + inset) & (F.col("maxy") <= F.col("_wmaxy") - inset))
    joined = salted_lookup(boxed, frame, keys, "inner", spread=["id"])
    return joined.where(inside).drop("_wminx", "_wminy", "_wmaxx", "_wmaxy")


def suitable_windows(faces: DataFrame, lines: DataFrame, keys: list[str], min_faces: int = 2,
                     min_length: float = 200.0) -> DataFrame:
    """Windows with enough faces and line length: ``keys, reference_count, line_length_m``."""
    counted = faces.groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_count"))
    length = lines.groupBy(*keys).agg(F.sum("length_m").alias("line_length_m"))
    return counted.join(length, keys).where(
        (F.col("reference_count") >= min_faces) & (F.col("line_length_m") >= min_length))


def extent(layer: DataFrame, keys: list[str], margin: float = 25.0) -> DataFrame:
    """Bounds of a layer grown by ``margin``."""
    from ..functions.geometry import with_bbox

    boxed = with_bbox(layer)
    return boxed.groupBy(*keys).agg(
        (F.min("minx") - margin).alias("minx"), (F.min("miny") - margin).alias("miny"),
        (F.max("maxx") + margin).alias("maxx"), (F.max("maxy") + margin).alias("maxy"))


def dataset_report(reviewed: DataFrame, matched: DataFrame, base_records: DataFrame, feedback_windows: DataFrame,
                   minimums: dict) -> DataFrame:
    """Counts of a reviewed-dataset build in one row; ``matched`` has id, training_role, class."""
    m = matched.agg(
        F.count(F.lit(1)).alias("matched_reviewed_features"),
        F.count_if(F.col("training_role") == "positive_boundary").alias("positive_boundaries"),
        F.count_if(F.col("training_role") == "hard_negative").alias("hard_negatives"))
    r = reviewed.agg(F.count(F.lit(1)).alias("reviewed_features"))
    w = feedback_windows.agg(F.count(F.lit(1)).alias("feedback_windows"))
    b = base_records.agg(*[F.count_if(F.col("split") == s).alias(f"base_{s}") for s in REQUIRED_SPLITS])
    c = combined_labels(base_records, feedback_windows).agg(F.count_if(F.col("split") == "train").alias("combined_train"))
    key = F.lit(1)
    out = m.withColumn("_k", key)
    for part in (r, w, b, c):
        out = out.join(part.withColumn("_k", key), "_k")
    ready = (
        (F.col("matched_reviewed_features") >= minimums["total"])
        & (F.col("positive_boundaries") >= minimums["positive_boundaries"])
        & (F.col("hard_negatives") >= minimums["hard_negatives"]))
    return (
        out.drop("_k")
        .withColumn("unmatched_reviewed_features", F.col("reviewed_features") - F.col("matched_reviewed_features"))
        .withColumn("matched_review_training_ready", ready)
        .withColumn("dataset_ready", ready & (F.col("feedback_windows") > 0)))
