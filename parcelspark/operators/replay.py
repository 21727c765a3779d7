"""Review events replayed into current parcels, history, corrections, evidence and queue.

Events are rows ``event_id, parcel_id, at, kind, correction_type, review_label,
rings, land_use, status``; ``kind`` is ``patch`` or ``verify``, null fields mean
"not given". Everything is an aggregate per parcel or a chunked ordering, so
a parcel with very many events is not gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..functions.once import computed_once
from .review import stored_correction_type
from .skew import chunked_lag, chunked_running_max, rows_not_listed, salted_lookup

ORDER = ["at", "event_id"]
# Kinds a single-boundary review cannot apply.
REFUSED_KINDS = ("split", "merge", "land_use_fix")
REFUSED_TEXT = "Use a dedicated split/merge or land-use workflow; this endpoint verifies a single boundary"
LABEL_TEXT = "False-positive review labels require correction_type=reject"


def refusal(kind: Column, correction_type: Column, label: Column) -> Column:
    """Why an event is not applied, or null."""
    return F.when(kind == "verify", F.when(correction_type.isin(*REFUSED_KINDS), REFUSED_TEXT).when(
        label.isNotNull() & (correction_type != "reject"), LABEL_TEXT))


@dataclass
class Replay:
    parcels: DataFrame
    versions: DataFrame
    corrections: DataFrame
    anomalies: DataFrame
    evidence: DataFrame
    queue: DataFrame
    refused: DataFrame


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, refused) events."""
    why = refusal(F.col("kind"), F.col("correction_type"), F.col("review_label"))
    judged = events.withColumn("refusal", why)
    return (
        judged.where(F.col("refusal").isNull()).drop("refusal"),
        judged.where(F.col("refusal").isNotNull()).select("event_id", "parcel_id", "refusal"),
    )


def _last(value: Column, when: Column) -> Column:
    return F.max_by(F.when(when, value), F.when(when, F.struct(*ORDER)))


def event_effects(applied: DataFrame) -> DataFrame:
    """One row per parcel that has events: what they add up to."""
    patch, verify = F.col("kind") == "patch", F.col("kind") == "verify"
    shaped = F.col("rings").isNotNull()
    reject = verify & (F.col("correction_type") == "reject")
    status = F.when(
        patch, F.coalesce("status", F.when(shaped, "needs_review"))
    ).otherwise(F.when(reject, "rejected").otherwise("verified"))
    with_status = applied.withColumn("_status", status)
    return with_status.groupBy("parcel_id").agg(
        F.count_if((patch & shaped) | verify).alias("_steps"),
        F.bool_or(shaped).alias("_reshaped"),
        _last(F.col("rings"), shaped).alias("_rings"),
        _last(F.col("_status"), F.col("_status").isNotNull()).alias("_status"),
        _last(F.col("land_use"), patch & F.col("land_use").isNotNull()).alias("_land_use"),
        F.bool_or(verify & ~reject).alias("_field_verified"),
        F.max(F.when(shaped, F.struct(*ORDER))).alias("_reshaped_at"),
        F.max(F.when(verify, F.col("at"))).alias("_verified_at"),
        F.min(F.when(verify & ~reject, F.struct(*ORDER))).alias("_first_accept"),
    )


def current_parcels(parcels: DataFrame, effects: DataFrame, geodesic: bool = False) -> DataFrame:
    """Parcels after all events; ``parcels`` carries ``rings`` and is otherwise kept. ``geodesic``: rings are lon/lat."""
    joined = parcels.join(effects, "parcel_id", "left")
    touched = F.coalesce("_reshaped", F.lit(False))
    out = joined.select(
        "parcel_id", "project_id",
        F.coalesce("_rings", "rings").alias("rings"),
        F.when(F.coalesce("_field_verified", F.lit(False)), "field_verified").otherwise(F.col("source")).alias("source"),
        F.coalesce("_status", "status").alias("status"),
        F.when(~touched, F.col("confidence")).alias("confidence"),
        F.when(~touched, F.col("health")).alias("health"),
        F.coalesce("_land_use", "land_use").alias("land_use"),
        (F.coalesce("version", F.lit(1)) + F.coalesce("_steps", F.lit(0))).cast("int").alias("version"),
    )
    return backfill_area(out, geodesic)


def archived_versions(applied: DataFrame, parcels: DataFrame, effects: DataFrame) -> DataFrame:
    """The boundary each geometry event replaced, with the source the parcel had then."""
    shaped = applied.where(F.col("rings").isNotNull()).select("parcel_id", *ORDER, "rings")
    lagged = chunked_lag(shaped, ["parcel_id"], ORDER, None, ["rings"])
    base = parcels.select("parcel_id", F.col("rings").alias("_base"), F.col("source").alias("_source")).join(
        effects.select("parcel_id", "_first_accept"), "parcel_id")
    joined = salted_lookup(lagged.drop("rings"), base, ["parcel_id"], "inner", spread=["event_id"])
    accepted_before = F.col("_first_accept").isNotNull() & (F.struct(*ORDER) > F.col("_first_accept"))
    return joined.select(
        "parcel_id", F.col("event_id").alias("version_id"), F.col("at").alias("captured_at"),
        F.coalesce("prev_rings", "_base").alias("rings"),
        F.when(accepted_before, "field_verified").otherwise(F.col("_source")).alias("source"))


def correction_rows(applied: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row per decision with the boundary before it and the one it leaves (the same, if it gave none).

    The boundary before a decision is the newest geometry of an earlier event: events with a
    geometry are looked up by the running maximum of their order, so no parcel's history is gathered.
    """
    shaped = F.when(F.col("rings").isNotNull(), F.struct(*ORDER))
    marked = applied.select("event_id", "parcel_id", "at", "kind", "correction_type", "review_label", "rings", shaped.alias("_shape"))
    seen = chunked_running_max(marked, ["parcel_id"], ORDER, None, "_shape", "_upto")
    own = seen.select("*", F.when(F.col("_shape").isNull(), F.col("_upto.event_id")).alias("_source"))
    lagged = chunked_lag(
        marked.where(F.col("_shape").isNotNull()).select("parcel_id", *ORDER, "rings"), ["parcel_id"], ORDER, None, ["rings"])
    before = lagged.select(F.col("event_id").alias("_own"), F.col("prev_rings").alias("_prev"), F.col("rings").alias("_now"))
    base = parcels.select("parcel_id", F.col("rings").alias("_base"))
    decided = own.where(F.col("kind") == "verify").withColumn("_own", F.coalesce(F.when(F.col("_shape").isNotNull(), F.col("event_id")), F.col("_source")))
    joined = salted_lookup(decided, before, ["_own"], "left", spread=["event_id"])
    joined = salted_lookup(joined, base, ["parcel_id"], "left", spread=["event_id"])
    given = F.col("_shape").isNotNull()
    original = F.coalesce(F.when(given, F.col("_prev")).otherwise(F.col("_now")), "_base")
    return joined.select(
        F.col("event_id").alias("correction_id"), "parcel_id",
        stored_correction_type(F.col("correction_type"), F.col("review_label")).alias("correction_type"),
        F.col("at").alias("created_at"), original.alias("original_rings"), F.coalesce("rings", original).alias("corrected_rings"))


def label_anomalies(applied: DataFrame) -> DataFrame:
    labelled = applied.where((F.col("kind") == "verify") & F.col("review_label").isNotNull())
    return labelled.select(
        F.col("event_id").alias("anomaly_id"), "parcel_id", F.col("review_label").alias("type"),
        F.lit(1.0).alias("magnitude"), F.col("at").alias("detected_at"))


def current_evidence(evidence: DataFrame, applied: DataFrame, effects: DataFrame) -> DataFrame:
    """Evidence that outlives geometry changes: untouched parcels keep theirs, later labels are added."""
    reshaped = effects.where("_reshaped").select("parcel_id", "_reshaped_at")
    kept = rows_not_listed(evidence, reshaped, ["parcel_id"])
    labelled = applied.where((F.col("kind") == "verify") & F.col("review_label").isNotNull())
    labels = salted_lookup(labelled.drop("rings"), reshaped, ["parcel_id"], "left", spread=["event_id"]).where(
        F.col("_reshaped_at").isNull() | (F.struct(*ORDER) >= F.col("_reshaped_at")))
    text = F.concat(
        F.lit("Human visual review labelled this geometry as "),
        F.replace("review_label", F.lit("_"), F.lit(" ")), F.lit("."))
    told = F.col("explanation") if "explanation" in evidence.columns else F.lit(None).cast("string")
    return kept.select("parcel_id", "component", "score", told.alias("explanation")).unionByName(
        labels.select("parcel_id", F.lit("review_label").alias("component"), F.lit(0.0).alias("score"),
                      text.alias("explanation")))


def closed_queue(queue: DataFrame, effects: DataFrame) -> DataFrame:
    """Open queue rows that a later decision on their parcel completes."""
    verified = effects.select("parcel_id", "_verified_at")
    joined = salted_lookup(queue, verified, ["parcel_id"], "left", spread=["queue_id"])
    closes = F.col("status").isin("pending", "assigned") & (F.col("_verified_at") >= F.col("created_at"))
    return joined.withColumn(
        "status", F.when(closes, "completed").otherwise(F.col("status"))).drop("_verified_at")


def replay(
    events: DataFrame, parcels: DataFrame, evidence: DataFrame, queue: DataFrame, geodesic: bool = False,
    users: DataFrame | None = None,
) -> Replay:
    """All tables after the events. ``parcels`` has one row per parcel and carries ``rings``; ``geodesic`` for lon/lat layers.

    With ``users``, events of kind ``assign`` (``queue_id``, ``assigned_to``) are applied too: an
    assignment is judged against the decisions before it, and a decision after it completes the row.
    """
    reviews = events.where(F.col("kind") != "assign")
    applied, refused = split_events(reviews)
    effects = event_effects(applied)
    assigned = queue
    if users is not None:
        decisions = applied.where(F.col("kind") == "verify").select("parcel_id", "at", "event_id")
        verdicts = assignment_verdicts(
            events.where(F.col("kind") == "assign").select("event_id", "queue_id", "assigned_to", "at"), queue, decisions, users)
        assigned = assigned_queue(queue, verdicts)
        of = queue.select("queue_id", "parcel_id")
        turned_down = verdicts.where(F.col("refusal").isNotNull()).select("event_id", "queue_id", "refusal")
        refused = refused.unionByName(salted_lookup(turned_down, of, ["queue_id"], "left", spread=["event_id"]).select(
            "event_id", "parcel_id", "refusal"))
    return Replay(
        parcels=current_parcels(parcels, effects, geodesic),
        versions=archived_versions(applied, parcels, effects),
        corrections=correction_rows(applied, parcels),
        anomalies=label_anomalies(applied),
        evidence=current_evidence(evidence, applied, effects),
        queue=closed_queue(assigned, effects),
        refused=refused,
    )


def assignment_verdicts(assigns: DataFrame, queue: DataFrame, decisions: DataFrame, users: DataFrame) -> DataFrame:
    """``event_id, queue_id, assigned_to, at, refusal`` of assignment events.

    An assignment is refused when its row was completed before it: stored as
    completed, or a decision on the parcel fell between the row's creation and
    the assignment. The last decision before each assignment comes from a
    chunked running maximum over both kinds of events.
    """
    row = queue.select("queue_id", "parcel_id", F.col("status").alias("_stored"), "created_at")
    placed = salted_lookup(assigns, row, ["queue_id"], "left", spread=["event_id"])
    known = users.select(F.col("user_id").alias("assigned_to"), F.lit(True).alias("_known"))
    placed = salted_lookup(placed, known, ["assigned_to"], "left", spread=["event_id"])
    # an assignment to an unknown row has no parcel and no decisions before it
    lost = placed.where(F.col("parcel_id").isNull()).withColumn("_last_decision", F.lit(None).cast("timestamp"))
    timeline = placed.where(F.col("parcel_id").isNotNull()).select(
        "parcel_id", "at", "event_id", "queue_id", "assigned_to", "_stored", "created_at", "_known",
        F.lit(None).cast("timestamp").alias("_decided")
    ).unionByName(decisions.select(
        "parcel_id", "at", "event_id", F.col("at").alias("_decided")), allowMissingColumns=True)
    seen = chunked_running_max(timeline, ["parcel_id"], ["at", "event_id"], None, "_decided", "_last_decision")
    # decisions are not assignments
    asked = seen.where(F.col("_decided").isNull()).drop("_decided").unionByName(lost.select(
        "parcel_id", "at", "event_id", "queue_id", "assigned_to", "_stored", "created_at", "_known", "_last_decision"))
    why = (
        F.when(F.col("_stored").isNull(), "Queue item not found")
        .when(F.col("assigned_to").isNotNull() & F.col("_known").isNull(), "Assignee must be an existing user ID")
        .when((F.col("_stored") == "completed") | (F.col("_last_decision") >= F.col("created_at")),
              "Completed surveys cannot be reassigned")
    )
    return asked.select("event_id", "queue_id", "assigned_to", "at", why.alias("refusal"))


def assigned_queue(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queue rows after their last accepted assignment (no assignee gives pending)."""
    last = verdicts.where(F.col("refusal").isNull()).groupBy("queue_id").agg(
        F.max_by(F.struct(F.col("assigned_to").alias("who")), F.struct("at", "event_id")).alias("_a"))
    joined = queue.join(last, "queue_id", "left")
    has = F.col("_a").isNotNull()
    return joined.withColumn(
        "status", F.when(has & (F.col("status") != "completed"),
                         F.when(F.col("_a.who").isNotNull(), "assigned").otherwise("pending")).otherwise(F.col("status"))
    ).withColumn("assigned_to", F.when(has, F.col("_a.who")).otherwise(F.col("assigned_to"))).drop("_a")


def delete_project(project_id: int, parcels: DataFrame, by_parcel: dict[str, DataFrame],
                   by_project: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without one project: children go with their parcels."""
    doomed = parcels.where(F.col("project_id") == project_id).select("parcel_id")
    out = {n: rows_not_listed(t, doomed, ["parcel_id"]) for n, t in by_parcel.items()}
    out.update({n: t.where(F.coalesce(F.col("project_id") != project_id, F.lit(True))) for n, t in by_project.items()})
    out["parcels"] = parcels.where(F.col("project_id") != project_id)
    return out


def backfill_area(layer: DataFrame, geodesic: bool = True) -> DataFrame:
    """``area_sqm`` of every polygon, ellipsoidal for lon/lat layers."""
    from ..functions.projection import geodesic_area

    return computed_once(layer, area_sqm=geodesic_area("rings") if geodesic else polygon_area("rings"))
