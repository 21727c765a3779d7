"""Listings, dashboards, change events and the review workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import confidence_band
from .skew import latest_by, rows_listed, salted_lookup

OPEN_STATUSES = ("pending", "assigned")
# Fixed value: provenance line shown when refinement evidence is stored.
PROVENANCE = "Frozen SegFormer + PPO vectorization v2 evidence stored"
TOPOLOGY_ERRORS = ("topology_break", "overlap")


def list_parcels(parcels: DataFrame, project_id: int | None = None, status: str | None = None,
                 min_confidence: float | None = None) -> DataFrame:
    """Filtered parcels with their band, least confident first, unknown confidence on top."""
    out = parcels
    if project_id is not None:
        out = out.where(F.col("project_id") == project_id)
    if status is not None:
        out = out.where(F.col("status") == status)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    return out.withColumn("confidence_band", confidence_band(F.col("confidence"))).orderBy(
        F.asc_nulls_first("confidence"), "parcel_id")


def dashboard(parcels: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: totals, verified, needing review, parcels with an open survey, mean confidence, mean health."""
    counts = parcels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.avg("confidence").alias("average_confidence"),
        F.avg("health").alias("average_health"),
    )
    # distinct first (partially aggregated), so a parcel with many rows costs one row
    waiting = queue.where(F.col("status").isin(*OPEN_STATUSES)).select("parcel_id").distinct().agg(
        F.count(F.lit(1)).alias("field_pending"))
    return counts.withColumn("_k", F.lit(1)).join(waiting.withColumn("_k", F.lit(1)), "_k").drop("_k")


def distribution(df: DataFrame, value: Column, missing: str) -> DataFrame:
    """``label, records, width``: counts per value, the empty bucket named, bar width at least 7 %."""
    counted = df.groupBy(F.coalesce(value, F.lit(missing)).alias("label")).agg(
        F.count(F.lit(1)).cast("long").alias("records"))
    share = F.col("records") / F.max("records").over(Window.partitionBy()) * 100
    return counted.withColumn("width", F.greatest(F.lit(7.0), share))


def project_status(projects: DataFrame, parcels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per project: parcels, parcels with evidence, parcels with refinement evidence, provenance, demo flag.

    Evidence is reduced to one row per parcel before it meets the parcels.
    """
    per_parcel = evidence.groupBy("parcel_id").agg(
        F.bool_or(F.col("component") == "rl_refinement").alias("refined"))
    counted = (
        parcels.select("project_id", "parcel_id").join(per_parcel, "parcel_id", "left")
        .groupBy("project_id").agg(
            F.count(F.lit(1)).alias("parcel_count"),
            F.count("refined").alias("evidence_parcel_count"),
            F.count_if(F.col("refined")).alias("rl_evidence_parcel_count"),
        )
    )
    return projects.join(counted, "project_id", "left").fillna(
        0, ["parcel_count", "evidence_parcel_count", "rl_evidence_parcel_count"]
    ).withColumn("demo", F.col("name").startswith("DEMO")).withColumn(
        "pipeline_provenance", F.when(F.col("rl_evidence_parcel_count") > 0, PROVENANCE))


def queue_listing(queue: DataFrame, parcels: DataFrame | None = None, project_id: int | None = None) -> DataFrame:
    """Queue rows by priority; with a project, only rows of its parcels."""
    rows = queue
    if project_id is not None:
        wanted = parcels.where(F.col("project_id") == project_id).select("parcel_id")
        rows = rows_listed(rows, wanted, ["parcel_id"], spread=["queue_id"])
    return rows.orderBy(F.desc("priority_score"), "queue_id")


def change_listing(anomalies: DataFrame, parcels: DataFrame, projects: DataFrame, since=None) -> DataFrame:
    """Anomalies with project and demo flag; the two dimension joins are salted for hot keys."""
    rows = anomalies if since is None else anomalies.where(F.col("detected_at") >= F.lit(since).cast("timestamp"))
    dim = salted_lookup(parcels.select("parcel_id", "project_id"), projects.select("project_id", "name"),
                        ["project_id"], "inner", spread=["parcel_id"])
    joined = salted_lookup(rows, dim, ["parcel_id"], "inner", spread=["anomaly_id"])
    return joined.withColumn("demo", F.col("name").startswith("DEMO")).drop("name")


def queue_by_parcel(queue: DataFrame) -> DataFrame:
    """Per parcel: rows waiting, best priority and the row that holds it."""
    best = F.max_by(F.struct("queue_id", "status"), F.struct("priority_score", -F.col("queue_id")))
    return queue.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("queue_rows"), F.max("priority_score").alias("top_priority"), best.alias("_b")
    ).select("parcel_id", "queue_rows", "top_priority", F.col("_b.queue_id").alias("top_queue_id"),
             F.col("_b.status").alias("top_status"))


def change_events(anomalies: DataFrame, parcels: DataFrame, queue: DataFrame) -> DataFrame:
    """Each anomaly with its parcel (null when unknown) and its parcel's queue summary.

    The queue list of a parcel is the same for all its events, so it stays in
    its own table (:func:`ranked_queue`) instead of being copied into each.
    """
    # one row per parcel on both sides; a queue row may name a parcel that is not stored
    known = parcels.select("parcel_id", "project_id", "land_use", F.lit(True).alias("parcel_known"))
    dim = known.join(queue_by_parcel(queue), "parcel_id", "full_outer")
    joined = salted_lookup(anomalies, dim, ["parcel_id"], "left", spread=["anomaly_id"])
    return joined.withColumn("parcel_known", F.coalesce("parcel_known", F.lit(False))).withColumn(
        "queue_rows", F.coalesce("queue_rows", F.lit(0)))


def ranked_queue(queue: DataFrame) -> DataFrame:
    """Queue rows of each parcel, best priority first (total order, range partitioned)."""
    return queue.orderBy("parcel_id", F.desc("priority_score"), "queue_id")


def event_search(events: DataFrame, query: str, kind: str | None = None, sort: str = "priority") -> DataFrame:
    """Case-insensitive search over parcel id and land use; sorted by priority or by date."""
    text = F.lower(F.concat_ws(" ", F.col("parcel_id").cast("string"), F.coalesce("land_use", F.lit(""))))
    rows = events.where(text.contains(query.lower()))
    if kind:
        rows = rows.where(F.col("type") == kind)
    if sort == "priority":
        return rows.orderBy(F.desc_nulls_last("top_priority"), "anomaly_id")
    return rows.orderBy(F.desc(F.coalesce(F.unix_micros("detected_at"), F.lit(0))), "anomaly_id")


def topology_errors(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(F.col("type").isin(*TOPOLOGY_ERRORS))


def change_summary(anomalies: DataFrame) -> DataFrame:
    """Per type: events and distinct parcels."""
    per_parcel = anomalies.groupBy("type", "parcel_id").agg(F.count(F.lit(1)).alias("n"))
    return per_parcel.groupBy("type").agg(
        F.sum("n").alias("events"), F.count(F.lit(1)).alias("parcels"))


def review_workspace(parcels: DataFrame, evidence: DataFrame, anomalies: DataFrame, queue: DataFrame) -> DataFrame:
    """One row per parcel: its evidence and anomaly lists, their summaries, first queue row, review flags.

    The lists are built per parcel once, in (time, batch, line) order, before the one join.
    """
    newest = lambda c: F.max_by(F.when(F.col("component") == c, F.col("score")), F.when(
        F.col("component") == c, F.struct("created_at", "batch", "line", "score")))
    ev = evidence.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("components"),
        newest("topology").alias("topology_score"),
        newest("rl_refinement").alias("rl_score"),
        F.array_sort(F.collect_list(F.struct("created_at", "batch", "line", "component", "score"))).alias("evidence"),
    )
    an = anomalies.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.bool_or(F.col("type").isin(*TOPOLOGY_ERRORS)).alias("has_topology_error"),
        F.bool_or(F.col("type").startswith("false_positive_")).alias("labelled_negative"),
        F.array_sort(F.collect_list(F.struct("detected_at", "anomaly_id", "type", "magnitude"))).alias("changes"),
    )
    qu = queue.groupBy("parcel_id").agg(
        F.min_by(F.struct("queue_id", "priority_score", "status"), F.col("queue_id")).alias("_q")
    ).select("parcel_id", "_q.queue_id", F.col("_q.priority_score").alias("queue_priority"),
             F.col("_q.status").alias("queue_status"))
    rows = parcels.join(ev, "parcel_id", "left").join(an, "parcel_id", "left").join(qu, "parcel_id", "left")
    return rows.fillna({"components": 0, "anomaly_count": 0, "has_topology_error": False, "labelled_negative": False}).withColumn(
        "manually_edited",
        (F.col("version") > 1) & F.col("confidence").isNull() & F.col("health").isNull())


def needs_review() -> Column:
    return F.col("status").isin("needs_review", "rejected")


def review_tab(workspace: DataFrame, tab: str, query: str = "", sort: str = "confidence") -> DataFrame:
    """Rows of a review tab, searched and sorted."""
    conditions = {
        "all": F.lit(True), "review": needs_review(),
        "field": F.col("queue_id").isNotNull(), "verified": F.col("status") == "verified",
    }
    text = F.lower(F.concat_ws(" ", F.col("parcel_id").cast("string"), F.coalesce("land_use", F.lit(""))))
    rows = workspace.where(conditions[tab] & text.contains(query.lower()))
    order = F.desc_nulls_last("queue_priority") if sort == "priority" else F.asc_nulls_last("confidence")
    return rows.orderBy(order, "parcel_id")


def review_counts(workspace: DataFrame) -> DataFrame:
    """Tab counts and label coverage, from statuses and false-positive anomalies."""
    agg = workspace.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(needs_review()).alias("review_rows"),
        F.count("queue_id").alias("field_rows"),
        F.count_if(F.col("status") == "verified").alias("verified_rows"),
        F.count_if(F.col("labelled_negative")).alias("labelled_negatives"),
    )
    total = F.col("verified_rows") + F.col("labelled_negatives")
    return agg.withColumn("reviewed_total", total).withColumn(
        "training_ready", (total >= 100) & (F.col("verified_rows") >= 40) & (F.col("labelled_negatives") >= 40))


# fixed text of a parcel without evidence
NO_EVIDENCE_TEXT = "No evidence rows yet. Seed demo data or wait for Dev 2 RL inference."


def explanation(parcels: DataFrame, evidence: DataFrame) -> DataFrame:
    """Narrative of each parcel from all its evidence texts, in (created_at, batch, line, component) order."""
    texts = evidence.groupBy("parcel_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("created_at", "batch", "line", "component", "text"))),
        lambda s: s["text"]).alias("_texts"))
    last = F.coalesce(F.try_element_at("_texts", F.lit(-1)), F.lit(NO_EVIDENCE_TEXT))
    whole = F.concat(
        F.format_string("Overall confidence %.2f. ", "confidence"),
        F.coalesce(F.array_join("_texts", " "), F.lit("")))
    narrative = F.when(F.col("confidence").isNotNull() & ~last.contains("Boundary"), whole).otherwise(last)
    trimmed = F.trim(narrative)
    return parcels.join(texts, "parcel_id", "left").select(
        "parcel_id", "confidence", "health",
        F.when(trimmed == "", "Seeded explanation unavailable.").otherwise(trimmed).alias("explanation"))
