"""Registered queries: listings, dashboards, change events, review workspace."""

from pyspark.sql import functions as F

from ..functions import formats, scoring as S
from ..operators import reports as R
from ..operators import skew
from ..sources import domain as D
from ..streaming import events
from .registry import query

R6 = lambda c: F.round(c, 6)
# priorities have at most eight decimals, so eight never meet a rounding tie
R8 = lambda c: F.round(c, 8)


@query("V1 V2 V3 O1 S5", """
    SELECT parcel_id, project_id, status, source, land_use, version, round(confidence, 6) AS confidence,
           CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM'
                WHEN confidence IS NOT NULL THEN 'LOW' END AS confidence_band
    FROM v_parcels WHERE status = 'needs_review' AND confidence >= 0.3""")
def parcel_listing(spark, sf):
    rows = R.list_parcels(D.parcels(spark, sf), status="needs_review", min_confidence=0.3)
    return rows.select("parcel_id", "project_id", "status", "source", "land_use", "version",
                       R6("confidence").alias("confidence"), "confidence_band")


@query("V2 A2", """
    SELECT band, action, count(*) AS parcels FROM (
      SELECT CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM' WHEN confidence IS NOT NULL THEN 'LOW' END AS band,
             CASE WHEN confidence >= 0.85 THEN 'eligible' WHEN confidence >= 0.60 THEN 'review' WHEN confidence IS NOT NULL THEN 'field' END AS action
      FROM v_parcels) GROUP BY 1, 2""")
def confidence_bands(spark, sf):
    band = S.confidence_band(F.col("confidence"))
    return (D.parcels(spark, sf).select(band.alias("band"), S.band_action(band).alias("action"))
            .groupBy("band", "action").agg(F.count(F.lit(1)).alias("parcels")))


@query("A1 A3 U6", """
    SELECT (SELECT count(*) FROM v_parcels) AS total,
           (SELECT count(*) FROM v_parcels WHERE status = 'verified') AS verified,
           (SELECT count(*) FROM v_parcels WHERE status = 'needs_review') AS needs_review,
           (SELECT round(avg(confidence), 6) FROM v_parcels) AS average_confidence,
           (SELECT round(avg(health), 6) FROM v_parcels) AS average_health,
           (SELECT count(DISTINCT parcel_id) FROM v_queue WHERE status IN ('pending', 'assigned')) AS field_pending""")
def dashboard_totals(spark, sf):
    return R.dashboard(D.parcels(spark, sf), D.survey_queue(spark, sf)).withColumn(
        "average_confidence", R6("average_confidence")).withColumn("average_health", R6("average_health"))


def _distribution_sql(source: str, label: str) -> str:
    return f"""
    SELECT label, records, round(greatest(7.0, records / max(records) OVER () * 100), 6) AS width
    FROM (SELECT {label} AS label, count(*) AS records FROM {source} GROUP BY 1)"""


@query("A2", _distribution_sql("v_parcels", "coalesce(land_use, 'Unclassified')"))
def land_use_distribution(spark, sf):
    return R.distribution(D.parcels(spark, sf), F.col("land_use"), "Unclassified").withColumn("width", R6("width"))


@query("A2 V2", _distribution_sql("v_parcels", """CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM'
    WHEN confidence IS NOT NULL THEN 'LOW' ELSE 'Not reported' END"""))
def band_distribution(spark, sf):
    return R.distribution(D.parcels(spark, sf), S.confidence_band(F.col("confidence")), "Not reported").withColumn("width", R6("width"))


@query("A2", _distribution_sql("v_queue", "status"))
def survey_workflow_distribution(spark, sf):
    return R.distribution(D.survey_queue(spark, sf), F.col("status"), "Not reported").withColumn("width", R6("width"))


@query("A4 J15 V12", """
    SELECT p.project_id, p.name, p.status, count(c.parcel_id) AS parcel_count, count(e.parcel_id) AS evidence_parcel_count,
           count(*) FILTER (WHERE e.refined) AS rl_evidence_parcel_count, p.name LIKE 'DEMO%' AS demo,
           CASE WHEN count(*) FILTER (WHERE e.refined) > 0 THEN 'Frozen SegFormer + PPO vectorization v2 evidence stored' END AS pipeline_provenance
    FROM v_projects p LEFT JOIN v_parcels c USING (project_id)
    LEFT JOIN (SELECT parcel_id, bool_or(component = 'rl_refinement') AS refined FROM v_evidence GROUP BY 1) e ON e.parcel_id = c.parcel_id
    GROUP BY 1, 2, 3""")
def project_status(spark, sf):
    return R.project_status(D.projects(spark, sf).drop("created_at"), D.parcels(spark, sf), D.evidence(spark, sf))


@query("O3 V12", """
    SELECT project_id, name, name LIKE 'DEMO%' AS demo, row_number() OVER (ORDER BY DATE '2024-01-01' + CAST(project_id * 37 % 365 AS INTEGER) DESC, project_id) - 1 AS place
    FROM v_projects""")
def project_listing(spark, sf):
    """Newest projects first, with their place in the listing."""
    rows = D.projects(spark, sf).withColumn("_newest", -F.unix_timestamp("created_at")).withColumn("_all", F.lit(0))
    ranked = skew.chunked_rank(rows, ["_all"], ["_newest", "project_id"], None, "place")
    return ranked.orderBy("place").select("project_id", "name", F.col("name").startswith("DEMO").alias("demo"), "place")


@query("O2 J11", """
    SELECT queue_id, parcel_id, round(priority_score, 8) AS priority_score, status
    FROM v_queue WHERE parcel_id IN (SELECT parcel_id FROM v_parcels WHERE project_id = 1)""")
def project_survey_queue(spark, sf):
    rows = R.queue_listing(D.survey_queue(spark, sf), D.parcels(spark, sf), project_id=1)
    return rows.select("queue_id", "parcel_id", R8("priority_score").alias("priority_score"), "status")


@query("O2", """
    SELECT queue_id, parcel_id, round(priority_score, 8) AS priority_score FROM v_queue""")
def top_survey_priorities(spark, sf):
    return R.queue_listing(D.survey_queue(spark, sf)).select(
        "queue_id", "parcel_id", R8("priority_score").alias("priority_score"))


@query("J12 V19 V12", """
    SELECT a.anomaly_id, a.parcel_id, a.type, round(a.magnitude, 6) AS magnitude, p.project_id, j.name LIKE 'DEMO%' AS demo
    FROM v_anomalies a JOIN v_parcels p USING (parcel_id) JOIN v_projects j ON j.project_id = p.project_id
    WHERE a.detected_at >= TIMESTAMP '2024-01-15 00:00:00'""")
def recent_changes(spark, sf):
    rows = R.change_listing(D.anomalies(spark, sf), D.parcels(spark, sf), D.projects(spark, sf), since="2024-01-15 00:00:00")
    return rows.select("anomaly_id", "parcel_id", "type", R6("magnitude").alias("magnitude"), "project_id", "demo")


_EVENTS = """
    SELECT a.anomaly_id, a.parcel_id, a.type, p.parcel_id IS NOT NULL AS parcel_known, p.land_use, p.project_id,
           coalesce(q.queue_rows, 0) AS queue_rows, round(q.top_priority, 8) AS top_priority, q.top_queue_id, q.top_status
    FROM v_anomalies a LEFT JOIN v_parcels p USING (parcel_id)
    LEFT JOIN (SELECT parcel_id, count(*) AS queue_rows, max(priority_score) AS top_priority,
                      arg_max(queue_id, {'p': priority_score, 'q': -queue_id}) AS top_queue_id,
                      arg_max(status, {'p': priority_score, 'q': -queue_id}) AS top_status
               FROM v_queue GROUP BY 1) q ON q.parcel_id = a.parcel_id"""
_EVENT_COLUMNS = ["anomaly_id", "parcel_id", "type", "parcel_known", "land_use", "project_id",
                  "queue_rows", "top_priority", "top_queue_id", "top_status"]


def _events(spark, sf):
    return R.change_events(D.anomalies(spark, sf), D.parcels(spark, sf), D.survey_queue(spark, sf))


@query("J13 O5", _EVENTS)
def change_events(spark, sf):
    return _events(spark, sf).withColumn("top_priority", R8("top_priority")).select(*_EVENT_COLUMNS)


@query("V16 V18 O5", f"""
    SELECT anomaly_id, parcel_id, type, top_priority FROM ({_EVENTS})
    WHERE type = 'topology_break' AND lower(CAST(parcel_id AS VARCHAR) || ' ' || coalesce(land_use, '')) LIKE '%forest%'""")
def change_search(spark, sf):
    return R.event_search(_events(spark, sf), "Forest", kind="topology_break").select(
        "anomaly_id", "parcel_id", "type", R8("top_priority").alias("top_priority"))


@query("J13", "SELECT parcel_id, queue_id, round(priority_score, 8) AS priority_score, status FROM v_queue")
def ranked_survey_queue(spark, sf):
    return R.ranked_queue(D.survey_queue(spark, sf)).select(
        "parcel_id", "queue_id", R8("priority_score").alias("priority_score"), "status")


@query("A21 A29", "SELECT type, count(*) AS events, count(DISTINCT parcel_id) AS parcels FROM v_anomalies GROUP BY 1")
def change_summary(spark, sf):
    return R.change_summary(D.anomalies(spark, sf))


@query("V18", "SELECT anomaly_id, parcel_id, type FROM v_anomalies WHERE type IN ('topology_break', 'overlap')")
def topology_error_events(spark, sf):
    return R.topology_errors(D.anomalies(spark, sf)).select("anomaly_id", "parcel_id", "type")


_WORKSPACE = """
    SELECT p.parcel_id, p.status, p.land_use, p.confidence, coalesce(e.components, 0) AS components, e.evidence_list, a.change_list, e.topology_score, e.rl_score,
           coalesce(a.anomaly_count, 0) AS anomaly_count, coalesce(a.topo, false) AS has_topology_error,
           coalesce(a.neg, false) AS labelled_negative, q.queue_id, q.queue_priority,
           (p.version > 1 AND p.confidence IS NULL AND p.health IS NULL) AS manually_edited
    FROM v_parcels p
    LEFT JOIN (SELECT parcel_id, count(*) AS components,
                      arg_max(score, {'a': created_at, 'b': batch, 'c': line, 'd': score}) FILTER (WHERE component = 'topology') AS topology_score,
                      arg_max(score, {'a': created_at, 'b': batch, 'c': line, 'd': score}) FILTER (WHERE component = 'rl_refinement') AS rl_score,
                      string_agg(component, ',' ORDER BY created_at, batch, line, component, score) AS evidence_list FROM v_evidence GROUP BY 1) e USING (parcel_id)
    LEFT JOIN (SELECT parcel_id, count(*) AS anomaly_count, string_agg(anomaly_id || ':' || type, ',' ORDER BY detected_at, anomaly_id) AS change_list, bool_or(type IN ('topology_break', 'overlap')) AS topo,
                      bool_or(type LIKE 'false_positive_%') AS neg FROM v_anomalies GROUP BY 1) a USING (parcel_id)
    LEFT JOIN (SELECT parcel_id, min(queue_id) AS queue_id, arg_min(priority_score, queue_id) AS queue_priority
               FROM v_queue GROUP BY 1) q USING (parcel_id)"""


def _workspace(spark, sf):
    return R.review_workspace(D.parcels(spark, sf), D.evidence(spark, sf), D.anomalies(spark, sf), D.survey_queue(spark, sf))


@query("J14 V14 O4", f"""
    SELECT parcel_id, status, components, round(topology_score, 6) AS topology_score, round(rl_score, 6) AS rl_score, anomaly_count,
           has_topology_error, labelled_negative, queue_id, round(queue_priority, 8) AS queue_priority, manually_edited,
           evidence_list, change_list
    FROM ({_WORKSPACE})""")
def review_workspace(spark, sf):
    return _workspace(spark, sf).select(
        "parcel_id", "status", "components", R6("topology_score").alias("topology_score"), R6("rl_score").alias("rl_score"),
        "anomaly_count", "has_topology_error", "labelled_negative", "queue_id",
        R8("queue_priority").alias("queue_priority"), "manually_edited",
        F.array_join(F.col("evidence.component"), ",").alias("evidence_list"),
        F.array_join(F.transform("changes", lambda c: F.concat(c["anomaly_id"].cast("string"), F.lit(":"), c["type"])), ",").alias("change_list"))


@query("V15 V16 O4", f"""
    SELECT parcel_id, status, round(queue_priority, 8) AS queue_priority FROM ({_WORKSPACE})
    WHERE status IN ('needs_review', 'rejected') AND lower(CAST(parcel_id AS VARCHAR) || ' ' || coalesce(land_use, '')) LIKE '%water%'""")
def review_tab_search(spark, sf):
    return R.review_tab(_workspace(spark, sf), "review", "water", "priority").select(
        "parcel_id", "status", R8("queue_priority").alias("queue_priority"))


@query("A20 V15", f"""
    SELECT *, verified_rows + labelled_negatives AS reviewed_total,
           verified_rows + labelled_negatives >= 100 AND verified_rows >= 40 AND labelled_negatives >= 40 AS training_ready
    FROM (SELECT count(*) AS all_rows, count(*) FILTER (WHERE status IN ('needs_review', 'rejected')) AS review_rows,
                 count(queue_id) AS field_rows, count(*) FILTER (WHERE status = 'verified') AS verified_rows,
                 count(*) FILTER (WHERE labelled_negative) AS labelled_negatives FROM ({_WORKSPACE}))""")
def review_counts(spark, sf):
    return R.review_counts(_workspace(spark, sf))


@query("V17", "SELECT parcel_id, source, status FROM v_parcels WHERE source IN ('ai_extracted', 'field_verified') AND status <> 'rejected'")
def visible_parcels(spark, sf):
    return D.parcels(spark, sf).where(
        F.col("source").isin("ai_extracted", "field_verified") & F.col("status").isin("ai_processed", "needs_review", "verified")
    ).select("parcel_id", "source", "status")


@query("F17", """
    SELECT p.parcel_id, trim(CASE
             WHEN p.confidence IS NOT NULL AND coalesce(t.last_text, 'No evidence rows yet. Seed demo data or wait for Dev 2 RL inference.') NOT LIKE '%Boundary%'
             THEN printf('Overall confidence %.2f. ', p.confidence) || coalesce(t.all_text, '')
             ELSE coalesce(t.last_text, 'No evidence rows yet. Seed demo data or wait for Dev 2 RL inference.') END) AS explanation
    FROM v_parcels p LEFT JOIN (
      SELECT parcel_id, string_agg(text, ' ' ORDER BY created_at, batch, line, component) AS all_text,
             arg_max(text, {'a': created_at, 'b': batch, 'c': line, 'd': component}) AS last_text
      FROM (SELECT *, CASE WHEN component = 'segmentation' THEN 'Boundary score ' ELSE component || ' score ' END || CAST(batch AS VARCHAR) AS text
            FROM v_evidence) GROUP BY 1) t USING (parcel_id)""")
def parcel_explanations(spark, sf):
    label = F.when(F.col("component") == "segmentation", "Boundary score ").otherwise(F.concat("component", F.lit(" score ")))
    ev = D.evidence(spark, sf).withColumn("text", F.concat(label, F.col("batch").cast("string")))
    return R.explanation(D.parcels(spark, sf), ev).select("parcel_id", "explanation")


@query("F20 F21 F22 F23", """
    SELECT anomaly_id, replace(type, '_', ' ') AS label, left(CAST(anomaly_id * 1000003 AS VARCHAR), 12) AS short_id,
           CASE WHEN anomaly_id % 7 = 0 THEN 'Date unavailable' ELSE strftime(detected_at, '%Y-%m-%d') END AS day,
           coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing
    FROM v_anomalies""")
def change_labels(spark, sf):
    text = F.when(F.col("anomaly_id") % 7 == 0, "bad date").otherwise(F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss"))
    return D.anomalies(spark, sf).select(
        "anomaly_id", formats.label_text(F.col("type")).alias("label"),
        formats.short_id((F.col("anomaly_id") * 1000003).cast("string")).alias("short_id"),
        formats.date_text(text).alias("day"),
        formats.json_property(F.col("props"), "k", "none").alias("k"),
        formats.json_property(F.col("props"), "missing", "none").alias("missing"))


@query("S12 U2", """
    SELECT 'parcels' AS kind, count(*) AS records FROM v_parcels UNION ALL
    SELECT 'projects', count(*) FROM v_projects UNION ALL SELECT 'queue', count(*) FROM v_queue""")
def snapshot_counts(spark, sf):
    from ..sources.sinks import snapshot_rows

    rows = snapshot_rows(D.projects(spark, sf), D.parcels(spark, sf), D.survey_queue(spark, sf))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


@query("A26", """
    SELECT project_id, round(quantile_cont(confidence, 0.5), 6) AS median_confidence, round(quantile_cont(confidence, 0.99), 6) AS p99_confidence
    FROM v_parcels WHERE confidence IS NOT NULL GROUP BY 1""")
def confidence_quantiles(spark, sf):
    q = skew.exact_quantiles(D.parcels(spark, sf), ["project_id"], "confidence", {"median_confidence": 0.5, "p99_confidence": 0.99})
    return q.select("project_id", R6("median_confidence").alias("median_confidence"), R6("p99_confidence").alias("p99_confidence"))


@query("X2", """
    SELECT strftime(a.detected_at, '%Y-%m-%d') AS day, a.type, p.project_id, count(*) AS events
    FROM v_anomalies a LEFT JOIN v_parcels p USING (parcel_id) WHERE a.detected_at IS NOT NULL GROUP BY 1, 2, 3""")
def daily_anomaly_counts(spark, sf):
    """The streaming aggregate on the batch table."""
    rows = events.daily_anomaly_counts(D.anomalies(spark, sf), D.parcels(spark, sf))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "type", "project_id", "events")
