"""Registered queries: review outcomes, label export, replayed state, imports, contracts."""

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import identity as I
from ..functions import projection as P
from ..functions import scoring as S
from ..operators import contracts as K
from ..operators import replay as X
from ..operators import review as V
from ..session import shared_folder
from ..sources import domain as D
from ..sources.commits import read_together
from .imports import import_features, import_payload
from .jobs import import_job
from .registry import query

R6 = lambda c: F.round(c, 6)

_LATEST = """
    SELECT parcel_id, correction_type FROM v_corrections
    QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01') DESC, correction_id DESC) = 1"""
_OUTCOME = f"""
    SELECT p.*, c.correction_type,
           CASE WHEN status = 'verified' AND c.correction_type NOT LIKE 'reject%' THEN 'positive_boundary'
                WHEN status = 'rejected' AND c.correction_type IN ('reject_building', 'reject_road', 'reject_canal', 'reject_other') THEN 'hard_negative' END AS training_role
    FROM v_parcels p LEFT JOIN ({_LATEST}) c USING (parcel_id)"""


def _outcomes(spark, sf):
    return V.review_outcomes(D.parcels(spark, sf), D.corrections(spark, sf))


@query("A5 W3", _LATEST)
def latest_corrections(spark, sf):
    return V.latest_correction(D.corrections(spark, sf)).select("parcel_id", "correction_type")


@query("A6 O7", """
    SELECT parcel_id, string_agg(component || '=' || printf('%.2f', score), ',' ORDER BY component) AS evidence FROM v_newest_evidence GROUP BY 1""")
def evidence_maps(spark, sf):
    entries = F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return V.evidence_map(D.evidence(spark, sf)).select("parcel_id", F.array_join(entries, ",").alias("evidence"))


@query("A7", f"""
    SELECT parcel_id, training_role, CASE training_role WHEN 'positive_boundary' THEN 'verified_boundary' WHEN 'hard_negative' THEN 'false_positive' END AS review_outcome,
           CASE WHEN training_role = 'hard_negative' THEN replace(correction_type, 'reject_', '') END AS false_positive_class
    FROM ({_OUTCOME})""")
def review_outcomes(spark, sf):
    return _outcomes(spark, sf).select("parcel_id", "training_role", "review_outcome", "false_positive_class")


@query("A8 O7 S11", f"""
    SELECT project_id, count(*) AS project_parcels, count(training_role) AS eligible_reviewed_labels,
           count(*) FILTER (WHERE training_role = 'positive_boundary') AS positive_boundaries,
           count(*) FILTER (WHERE training_role = 'hard_negative') AS hard_negatives,
           count(*) FILTER (WHERE training_role = 'hard_negative' AND correction_type = 'reject_road') AS road_labels,
           count(*) FILTER (WHERE status = 'rejected' AND correction_type IS NOT NULL AND training_role IS NULL) AS rejected_without_specific_label,
           count(*) - count(training_role) AS unreviewed_or_ineligible,
           count(training_role) >= 100 AND count(*) FILTER (WHERE training_role = 'positive_boundary') >= 40
             AND count(*) FILTER (WHERE training_role = 'hard_negative') >= 40 AS training_ready
    FROM ({_OUTCOME}) GROUP BY 1""")
def label_export_summary(spark, sf):
    return V.export_summary(_outcomes(spark, sf), ["project_id"]).withColumn(
        "road_labels", F.coalesce(F.col("false_positive_classes")["road"], F.lit(0)).cast("long")).drop("false_positive_classes")


@query("S10 S9 V3 G33", f"""
    SELECT o.parcel_id, 'Polygon' AS geometry_type, CASE WHEN o.parcel_id % 5 = 0 THEN 7 ELSE 5 END AS positions, o.training_role AS role,
           CAST(o.parcel_id AS VARCHAR) AS feature_parcel, coalesce(e.n, 0) AS evidence_entries
    FROM ({_OUTCOME}) o LEFT JOIN (SELECT parcel_id, count(*) AS n FROM v_newest_evidence GROUP BY 1) e USING (parcel_id)
    WHERE training_role IS NOT NULL""")
def label_export_features(spark, sf):
    rows = V.export_features(_outcomes(spark, sf), D.parcel_layer(spark, sf), D.evidence(spark, sf))
    doc = F.from_json("feature", "geometry struct<type:string,coordinates:array<array<array<double>>>>, "
                                 "properties struct<parcel_id:string,training_role:string,evidence:map<string,double>>")
    return rows.select("parcel_id", doc.alias("d")).select(
        "parcel_id", F.col("d.geometry.type").alias("geometry_type"), F.size(F.col("d.geometry.coordinates")[0]).alias("positions"),
        F.col("d.properties.training_role").alias("role"), F.col("d.properties.parcel_id").alias("feature_parcel"),
        F.size("d.properties.evidence").alias("evidence_entries"))


# --- replay ------------------------------------------------------------------

def _events(spark, sf):
    """Orders as review events: 5 patches to 8 decisions, some with a new boundary, some not applicable."""
    k = F.col("event_id")
    base = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("parcel_id"),
        F.col("o_orderdate").cast("timestamp").alias("at"))
    kind = F.when(k % 13 < 5, "patch").otherwise("verify")
    ctype = F.when(k % 11 == 0, "split").when(k % 3 == 0, "reject").otherwise("boundary_adjust")
    return base.select(
        "event_id", "parcel_id", "at", kind.alias("kind"),
        F.when(kind == "verify", ctype).alias("correction_type"),
        F.when((kind == "verify") & (k % 6 == 0), "false_positive_road").alias("review_label"),
        F.when(k % 7 == 0, D.version_rings(k, F.col("parcel_id"))).alias("rings"),
        F.when((kind == "patch") & (k % 4 == 0), "orchard").alias("land_use"),
        F.when((kind == "patch") & (k % 9 == 0), "ai_processed").alias("status"))


_EVENTS = """
    SELECT *, CASE WHEN kind = 'verify' AND correction_type = 'split' THEN 1 WHEN review_label IS NOT NULL AND correction_type <> 'reject' THEN 2 ELSE 0 END AS refused
    FROM (SELECT o_orderkey AS event_id, o_custkey AS parcel_id, o_orderdate AS happened, kind,
                 CASE WHEN kind = 'verify' THEN CASE WHEN o_orderkey % 11 = 0 THEN 'split' WHEN o_orderkey % 3 = 0 THEN 'reject' ELSE 'boundary_adjust' END END AS correction_type,
                 CASE WHEN kind = 'verify' AND o_orderkey % 6 = 0 THEN 'false_positive_road' END AS review_label,
                 o_orderkey % 7 = 0 AS shaped, CASE WHEN kind = 'patch' AND o_orderkey % 4 = 0 THEN 'orchard' END AS land_use,
                 CASE WHEN kind = 'patch' AND o_orderkey % 9 = 0 THEN 'ai_processed' END AS set_status
          FROM (SELECT *, CASE WHEN o_orderkey % 13 < 5 THEN 'patch' ELSE 'verify' END AS kind FROM orders))"""
_APPLIED = f"""
    SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY happened, event_id) AS n,
           CASE WHEN kind = 'patch' THEN coalesce(set_status, CASE WHEN shaped THEN 'needs_review' END)
                WHEN correction_type = 'reject' THEN 'rejected' ELSE 'verified' END AS to_status
    FROM ({_EVENTS}) WHERE refused = 0"""
_EFFECTS = f"""
    SELECT parcel_id, count(*) FILTER (WHERE kind = 'verify' OR shaped) AS steps, bool_or(shaped) AS reshaped,
           arg_max(event_id, n) FILTER (WHERE shaped) AS shape_event, arg_max(to_status, n) FILTER (WHERE to_status IS NOT NULL) AS to_status,
           bool_or(kind = 'verify' AND correction_type <> 'reject') AS accepted, max(land_use) AS land_use,
           max(n) FILTER (WHERE shaped) AS shape_n, min(n) FILTER (WHERE kind = 'verify' AND correction_type <> 'reject') AS first_accept,
           max(happened) FILTER (WHERE kind = 'verify') AS verified_at
    FROM ({_APPLIED}) GROUP BY 1"""


def _stored_parcels(spark, sf):
    return D.parcels(spark, sf).join(
        D.parcel_layer(spark, sf).select(F.col("id").alias("parcel_id"), "rings"), "parcel_id")


def _replayed(spark, sf):
    return X.replay(_events(spark, sf), _stored_parcels(spark, sf), D.evidence(spark, sf), D.survey_queue(spark, sf))


@query("T1 T2 X1 V14", f"""
    SELECT p.parcel_id, coalesce(e.to_status, p.status) AS status, CASE WHEN e.accepted THEN 'field_verified' ELSE p.source END AS source,
           CASE WHEN coalesce(e.reshaped, false) THEN NULL ELSE round(p.confidence, 6) END AS confidence, coalesce(e.land_use, p.land_use) AS land_use,
           p.version + coalesce(e.steps, 0) AS version,
           round(CASE WHEN e.reshaped THEN (w + shape_event % 5 - 2) * (h + shape_event % 3 - 1) ELSE a.area END, 6) AS area_sqm
    FROM v_parcels p LEFT JOIN ({_EFFECTS}) e USING (parcel_id) JOIN v_lattice l ON l.id = p.parcel_id JOIN v_parcel_area a ON a.id = p.parcel_id""")
def replayed_parcels(spark, sf):
    return _replayed(spark, sf).parcels.select(
        "parcel_id", "status", "source", R6("confidence").alias("confidence"), "land_use", "version", R6("area_sqm").alias("area_sqm"))


@query("T1 T2 W1", f"""
    SELECT s.parcel_id, s.event_id AS version_id, CASE WHEN s.n > e.first_accept THEN 'field_verified' ELSE p.source END AS source,
           round(CASE WHEN s.prev IS NOT NULL THEN (w + s.prev % 5 - 2) * (h + s.prev % 3 - 1) ELSE a.area END, 6) AS area
    FROM (SELECT *, lag(event_id) OVER (PARTITION BY parcel_id ORDER BY n) AS prev FROM ({_APPLIED}) WHERE shaped) s
    JOIN v_parcels p USING (parcel_id) JOIN ({_EFFECTS}) e USING (parcel_id)
    JOIN v_lattice l ON l.id = s.parcel_id JOIN v_parcel_area a ON a.id = s.parcel_id""")
def replayed_versions(spark, sf):
    return _replayed(spark, sf).versions.select(
        "parcel_id", "version_id", "source", R6(G.polygon_area("rings")).alias("area"))


@query("T2 V13", f"""
    SELECT event_id AS correction_id, parcel_id,
           CASE WHEN correction_type = 'reject' AND review_label IS NOT NULL THEN 'reject_road' ELSE correction_type END AS correction_type
    FROM ({_EVENTS}) WHERE refused = 0 AND kind = 'verify'""")
def replayed_corrections(spark, sf):
    return _replayed(spark, sf).corrections.select("correction_id", "parcel_id", "correction_type")


@query("T1 T2", f"""
    SELECT parcel_id, component, round(score, 6) AS score FROM v_evidence
    WHERE parcel_id NOT IN (SELECT parcel_id FROM ({_EFFECTS}) WHERE reshaped)
    UNION ALL
    SELECT a.parcel_id, 'review_label', 0.0 FROM ({_APPLIED}) a LEFT JOIN ({_EFFECTS}) e USING (parcel_id)
    WHERE a.review_label IS NOT NULL AND (e.shape_n IS NULL OR a.n >= e.shape_n)""")
def replayed_evidence(spark, sf):
    return _replayed(spark, sf).evidence.select("parcel_id", "component", R6("score").alias("score"))


@query("T2", f"""
    SELECT queue_id, CASE WHEN q.status <> 'completed' AND e.verified_at >= q.created_at THEN 'completed' ELSE q.status END AS status
    FROM v_queue q LEFT JOIN ({_EFFECTS}) e USING (parcel_id)""")
def replayed_queue(spark, sf):
    return _replayed(spark, sf).queue.select("queue_id", "status")


@query("T3 V13", f"SELECT event_id, parcel_id, refused FROM ({_EVENTS}) WHERE refused > 0")
def refused_events(spark, sf):
    rows = _replayed(spark, sf).refused
    return rows.select("event_id", "parcel_id", F.when(F.col("refusal") == X.REFUSED_TEXT, 1).otherwise(2).alias("refused"))


@query("T2 A21", f"""
    SELECT event_id AS anomaly_id, parcel_id, review_label AS type FROM ({_EVENTS}) WHERE refused = 0 AND review_label IS NOT NULL""")
def replayed_anomalies(spark, sf):
    return _replayed(spark, sf).anomalies.select("anomaly_id", "parcel_id", "type")


def _assigns(spark, sf):
    o = D.table(spark, sf, "orders")
    return o.select(
        (F.col("o_orderkey") + 1_000_000_000).alias("event_id"),
        F.floor(F.col("o_orderkey") / 2).cast("long").alias("queue_id"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 130).alias("assigned_to"),
        F.col("o_orderdate").cast("timestamp").alias("at"))


_ASSIGNS = """
    SELECT a.*, CASE WHEN a.assigned_to IS NOT NULL AND a.assigned_to NOT IN (SELECT s_suppkey FROM supplier) THEN 'unknown'
             WHEN q.status = 'completed' OR EXISTS (SELECT 1 FROM v_corrections c WHERE c.parcel_id = q.parcel_id AND c.created_at IS NOT NULL
                    AND c.created_at >= q.created_at AND c.created_at <= a.happened) THEN 'completed' END AS refusal
    FROM (SELECT o_orderkey + 1000000000 AS event_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS queue_id,
                 CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 130 END AS assigned_to, o_orderdate AS happened
          FROM orders) a JOIN v_queue q USING (queue_id)"""


def _verdicts(spark, sf):
    decisions = D.corrections(spark, sf).where(F.col("created_at").isNotNull()).select(
        "parcel_id", F.col("created_at").alias("at"), F.col("correction_id").alias("event_id"))
    return X.assignment_verdicts(_assigns(spark, sf), D.survey_queue(spark, sf), decisions, D.users(spark, sf))


@query("T4 J25", f"SELECT event_id, queue_id, refusal FROM ({_ASSIGNS})")
def assignment_verdicts(spark, sf):
    why = F.when(F.col("refusal").startswith("Assignee"), "unknown").when(F.col("refusal").startswith("Completed"), "completed")
    return _verdicts(spark, sf).select("event_id", "queue_id", why.alias("refusal"))


@query("T4", f"""
    SELECT q.queue_id, CASE WHEN a.n IS NULL OR q.status = 'completed' THEN q.status WHEN a.who IS NULL THEN 'pending' ELSE 'assigned' END AS status,
           CASE WHEN a.n IS NULL THEN q.assigned_to ELSE a.who END AS assigned_to
    FROM v_queue q LEFT JOIN (
      SELECT queue_id, 1 AS n, arg_max_null(assigned_to, {{'a': happened, 'e': event_id}}) AS who FROM ({_ASSIGNS}) WHERE refusal IS NULL GROUP BY 1) a USING (queue_id)""")
def assigned_queue(spark, sf):
    return X.assigned_queue(D.survey_queue(spark, sf), _verdicts(spark, sf)).select("queue_id", "status", "assigned_to")


@query("T5", """
    SELECT 'evidence' AS kind, count(*) AS records FROM v_evidence WHERE parcel_id NOT IN (SELECT parcel_id FROM v_parcels WHERE project_id = 1)
    UNION ALL SELECT 'anomalies', count(*) FROM v_anomalies WHERE parcel_id NOT IN (SELECT parcel_id FROM v_parcels WHERE project_id = 1)
    UNION ALL SELECT 'parcels', count(*) FROM v_parcels WHERE project_id <> 1
    UNION ALL SELECT 'projects', count(*) FROM v_projects WHERE project_id <> 1""")
def delete_project(spark, sf):
    left = X.delete_project(
        1, D.parcels(spark, sf), {"evidence": D.evidence(spark, sf), "anomalies": D.anomalies(spark, sf)},
        {"projects": D.projects(spark, sf)})
    counts = [t.agg(F.count(F.lit(1)).alias("records")).select(F.lit(n).alias("kind"), "records") for n, t in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# --- imports -----------------------------------------------------------------

def _payload(spark, sf):
    k = F.col("id")
    layer = D.parcel_layer(spark, sf)
    return layer.select(
        "id", "project_id", "rings", D.reference_rings(k).alias("baseline_rings"),
        ((k * 37 % 1000) / 1000.0).alias("confidence_score"), ((k * 53 % 100) / 100.0).alias("segmentation_score"),
        (1 - (k * 7 % 10) / 100.0).alias("topology_score"), ((k * 11 % 100) / 100.0).alias("edge_alignment_score"),
        ((k * 13 % 100) / 100.0).alias("deviation_from_baseline_score"),
        F.lit("Boundary moved.").alias("explanation"), F.sha2(k.cast("string"), 256).alias("policy_sha256"),
        F.lit(20000).cast("long").alias("timesteps"), (k % 2 == 0).alias("accepted"), (k % 3 == 0).alias("changed"))


_PAYLOAD = """
    SELECT *, least(1.0, 0.4 * ratio + 0.6 * share) AS d FROM (
      SELECT a.id, a.project_id, (a.id * 37 % 1000) / 1000.0::DOUBLE AS c, 1 - (a.id * 7 % 10) / 100.0::DOUBLE AS t, a.area,
             least(1.0, abs(a.area - r.area) / r.area) AS ratio,
             least(1.0, (a.area + r.area - 2 * i.inter_area) / (a.area + r.area - i.inter_area)) AS share
      FROM v_parcel_area a JOIN v_ref_area r USING (id) JOIN v_parcel_ref_inter i ON i.a_id = a.id AND i.b_id = a.id)"""


_SOUTH = "(23.3 + (project_id % 100) * 0.02 + {y} * 1e-5)"


def _band(lat: str) -> str:
    """Ellipsoidal area north of the equator per radian, over the squared axis."""
    s = f"sin(radians({lat}))"
    return f"(1 - {P._E2!r}) * ({s} / (1 - {P._E2!r} * {s} ** 2) + atanh({P._E!r} * {s}) / {P._E!r}) / 2"


# area of a box on the equal-area plane, from sides in steps of 1e-5 degrees
_PLANE = (
    f"{P.WGS84_A!r}::DOUBLE ** 2 * radians(({{x1}} - {{x0}}) * 1e-5) * ("
    + _band(_SOUTH.replace("{y}", "{y1}")) + " - (" + _band(_SOUTH.replace("{y}", "{y0}")) + "))")


def _imported(spark, sf):
    return import_payload(_payload(spark, sf), F.lit("2024-01-01").cast("timestamp"), lonlat=False)


@query("T6 F3 V10", f"""
    SELECT id, CASE WHEN c >= 0.85 THEN 'ai_processed' ELSE 'needs_review' END AS status, round(area, 6) AS area_sqm,
           round(0.4 * c + 0.2 * CASE WHEN t < 0.999 THEN 0 ELSE 1 END + 0.2 * (1 - d) + 0.2 * (1 - ratio), 4) AS health_score
    FROM ({_PAYLOAD})""")
def imported_parcels(spark, sf):
    return _imported(spark, sf).parcels.select("id", "status", R6("area_sqm").alias("area_sqm"), "health_score")


@query("T6 V11", f"""
    SELECT id AS parcel_id, UNNEST(['segmentation', 'topology', 'edge_alignment', 'deviation_from_baseline', 'rl_refinement']) AS component,
           round(UNNEST([(id * 53 % 100) / 100.0::DOUBLE, t, (id * 11 % 100) / 100.0::DOUBLE, (id * 13 % 100) / 100.0::DOUBLE, (id * 11 % 100) / 100.0::DOUBLE]), 6) AS score,
           UNNEST(['Calibrated SegFormer boundary-probability alignment stored by the selected vectorization run.',
                   'Topology score reported after validity and overlap rejection gates.',
                   'Refined boundary alignment with local raster edge evidence.',
                   'Baseline agreement; measured discrepancy=' || printf('%.4f', d) || '.',
                   'PPO policy ' || left(sha256(CAST(id AS VARCHAR)), 12) || ' ran for 20,000 timesteps; candidate accepted='
                     || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || ', changed=' || CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END
                     || '. Boundary moved.']) AS explanation
    FROM ({_PAYLOAD})""")
def imported_evidence(spark, sf):
    return _imported(spark, sf).evidence.withColumn("score", R6("score"))


@query("T6 F5 F4", f"""
    SELECT id AS parcel_id, a.type, a.m AS magnitude FROM (SELECT id, UNNEST(list_filter([
        CASE WHEN c < 0.60 THEN {{'type': 'boundary_shift', 'm': round(1 - c, 4)}} END,
        CASE WHEN d >= 0.30 THEN {{'type': 'boundary_shift', 'm': round(d, 4)}} END,
        CASE WHEN t < 0.999 THEN {{'type': 'topology_break', 'm': round(1 - t, 4)}} END,
        CASE WHEN ratio >= 0.50 THEN {{'type': 'encroachment', 'm': round(ratio, 4)}} END], lambda x: x IS NOT NULL)) AS a
      FROM ({_PAYLOAD}))""")
def imported_anomalies(spark, sf):
    return _imported(spark, sf).anomalies


@query("T6 F6 F7", f"""
    SELECT id AS parcel_id, round(0.40 * (1 - c) + 0.25 * d + 0.15 * ratio + 0.10 * least(1.0, n / 3.0) + 0.10 * (t < 0.999)::INT, 4) AS priority_score,
           coalesce(nullif(concat_ws(', ', CASE WHEN c < 0.60 THEN 'low confidence' END, CASE WHEN d >= 0.30 THEN 'historical/record discrepancy' END,
             CASE WHEN ratio >= 0.50 THEN 'historical instability' END, CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' anomaly(s)' END,
             CASE WHEN t < 0.999 THEN 'topology violation' END), ''), 'low-risk parcel; routine review') AS reason, 'pending' AS status
    FROM (SELECT *, (c < 0.60)::INT + (d >= 0.30)::INT + (t < 0.999)::INT + (ratio >= 0.50)::INT AS n FROM ({_PAYLOAD}))""")
def imported_queue(spark, sf):
    return _imported(spark, sf).queue


def _imported_lonlat(spark, sf):
    """The payload on longitude and latitude, imported by the write job into a new root and read back."""
    place = lambda c: G.map_points(c, lambda x, y: G.point(85.3 + x * 1e-5, 23.3 + (F.col("project_id") % 100) * 0.02 + y * 1e-5))
    payload = _payload(spark, sf).withColumns({"rings": place("rings"), "baseline_rings": place("baseline_rings")})
    root = shared_folder(spark, "import")
    projects = payload.select("project_id").distinct()
    import_job(payload, D.parcels(spark, sf).where("false"), projects, root, "run-1", F.lit("2024-01-01").cast("timestamp"))
    return read_together(spark, root, "run-1")


# parcels and references are boxes on both axes of the equal-area plane, so areas follow from box sides
_LONLAT = f"""
    SELECT *, least(1.0, 0.4 * ratio + 0.6 * share) AS d FROM (
      SELECT a.id, (a.id * 37 % 1000) / 1000.0::DOUBLE AS c, 1 - (a.id * 7 % 10) / 100.0::DOUBLE AS t, a.area,
             least(1.0, abs(a.area - r.area) / r.area) AS ratio, least(1.0, (a.area + r.area - 2 * i.inter) / (a.area + r.area - i.inter)) AS share
      FROM (SELECT id, sum(s * {_PLANE.format(x0='x0', x1='x1', y0='y0', y1='y1')}) AS area FROM v_parcel_boxes GROUP BY 1) a
      JOIN (SELECT id, {_PLANE.format(x0='x0', x1='x1', y0='y0', y1='y1')} AS area FROM v_ref_boxes) r USING (id)
      JOIN (SELECT id, sum(s * CASE WHEN lx < hx AND ly < hy THEN {_PLANE.format(x0='lx', x1='hx', y0='ly', y1='hy')} ELSE 0 END) AS inter
            FROM (SELECT p.id, p.project_id, p.s, greatest(p.x0, r.x0) AS lx, least(p.x1, r.x1) AS hx, greatest(p.y0, r.y0) AS ly, least(p.y1, r.y1) AS hy
                  FROM v_parcel_boxes p JOIN v_ref_boxes r USING (id)) GROUP BY 1) i USING (id))"""


@query("T6 S11 F3", f"""
    SELECT id, CASE WHEN c >= 0.85 THEN 'ai_processed' ELSE 'needs_review' END AS status, round(area, 2) AS area_sqm, 5 AS evidence_rows, 1 AS version_rows,
           (c < 0.60)::INT + (d >= 0.30)::INT + (t < 0.999)::INT + (ratio >= 0.50)::INT AS anomaly_rows,
           round(0.4 * c + 0.2 * CASE WHEN t < 0.999 THEN 0 ELSE 1 END + 0.2 * (1 - d) + 0.2 * (1 - ratio), 4) AS health_score,
           round(0.40 * (1 - c) + 0.25 * d + 0.15 * ratio + 0.10 * (t < 0.999)::INT
                 + 0.10 * least(1.0, ((c < 0.60)::INT + (d >= 0.30)::INT + (t < 0.999)::INT + (ratio >= 0.50)::INT) / 3.0), 4) AS priority_score
    FROM ({_LONLAT})""")
def imported_tables(spark, sf):
    t = _imported_lonlat(spark, sf)

    def rows(name):
        return t[name].groupBy(F.col("parcel_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias(f"{name}_n"))

    out = t["parcels"].select("id", "status", F.round("area_sqm", 2).alias("area_sqm"), "health_score")
    for name in ("evidence", "versions", "anomalies"):
        out = out.join(rows(name), "id", "left")
    out = out.join(t["queue"].select(F.col("parcel_id").alias("id"), "priority_score"), "id")
    return out.select(
        "id", "status", "area_sqm", F.col("evidence_n").alias("evidence_rows"), F.col("versions_n").alias("version_rows"),
        F.coalesce("anomalies_n", F.lit(0)).alias("anomaly_rows"), "health_score", "priority_score")


def _feature_rows(spark, sf):
    k = F.col("id")
    return D.lonlat_layer(spark, sf).select(
        "id", "project_id", "rings",
        F.when(k % 10 == 3, "building").otherwise("parcel").alias("class"), (k % 4 != 0).alias("has_raw_confidence"),
        F.when(k % 4 == 1, "0.75").when(k % 4 == 2, "1.5").when(k % 4 == 3, "true").alias("raw_confidence"),
        F.when(k % 6 != 0, F.concat(F.lit("tile-"), k.cast("string"))).alias("source_tile_id"))


@query("S1 V8 V9", """
    SELECT id, CASE WHEN id % 4 <> 0 THEN 'ai_extracted' ELSE 'existing_gis' END AS source, 'needs_review' AS status,
           CASE WHEN id % 4 = 1 THEN 0.75 END AS evidence_score, CASE WHEN id % 4 = 1 THEN 'Imported raw segmentation confidence from tile '
             || CASE WHEN id % 6 <> 0 THEN 'tile-' || CAST(id AS VARCHAR) ELSE 'unreported' END
             || '. This is not boundary confidence or proof of RL execution.' END AS evidence_text
    FROM v_lattice WHERE id % 10 <> 3""")
def imported_features(spark, sf):
    parcels, evidence, _ = import_features(_feature_rows(spark, sf))
    ev = evidence.select(F.col("parcel_id").alias("id"), F.col("score").alias("evidence_score"), F.col("explanation").alias("evidence_text"))
    return parcels.select("id", "source", "status").join(ev, "id", "left")


@query("S1", "SELECT id, 'parcel_class_only' AS rule FROM v_lattice WHERE id % 10 = 3")
def refused_features(spark, sf):
    return import_features(_feature_rows(spark, sf))[2]


# --- contracts ---------------------------------------------------------------

@query("V4 V24 F5", """
    SELECT id, CASE WHEN id % 29 = 0 THEN 'polygon_required' WHEN id % 23 = 0 THEN 'ring_positions' WHEN id % 19 = 0 THEN 'ring_closed'
                    WHEN id % 17 = 0 THEN 'position_2d' WHEN id % 13 = 0 THEN 'lon_lat_range' END AS rule
    FROM v_lattice WHERE id % 29 = 0 OR id % 23 = 0 OR id % 19 = 0 OR id % 17 = 0 OR id % 13 = 0""")
def polygon_contract(spark, sf):
    k = F.col("id")
    good = D.lonlat_layer(spark, sf).select("id", G.to_coordinates(F.slice("rings", 1, 1)).alias("c"))
    r = F.col("c")[0]
    broken = (
        F.when(k % 29 == 0, F.col("c"))
        .when(k % 23 == 0, F.array(F.concat(F.slice(r, 1, 2), F.slice(r, 1, 1))))
        .when(k % 19 == 0, F.array(F.slice(r, 1, F.size(r) - 1)))
        .when(k % 17 == 0, F.transform("c", lambda g: F.transform(g, lambda p: F.array_append(p, F.lit(0.0)))))
        .when(k % 13 == 0, F.transform("c", lambda g: F.transform(g, lambda p: F.array(p[0] + 200, p[1]))))
        .otherwise(F.col("c")))
    kind = F.when(k % 29 == 0, "Point").otherwise("Polygon")
    # a ring of a 4-vertex box stays long enough when its last position is cut
    docs = good.select("id", kind.alias("type"), broken.alias("coordinates"))
    rules = K.polygon_rules(F.col("type"), F.col("coordinates"), G.from_coordinates("coordinates"))
    return K.violations(docs, ["id"], rules)


def _payload_docs(spark, sf):
    k = F.col("c_custkey")
    uid = I.uuid5(k.cast("string"))
    return D.table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 31 == 0, "not-a-uuid").otherwise(F.upper(uid)).alias("parcel_id"),
        *[F.when(k % 12 == i, 1.2).otherwise((k * (i + 3) % 100) / 100.0).alias(s) for i, s in enumerate(K.SCORES)],
        F.when(k % 7 == 0, "").otherwise("fine").alias("explanation"), (k % 37 == 0).alias("demo"),
        F.when(k % 5 == 0, "short").otherwise(F.sha2(k.cast("string"), 256)).alias("policy_sha256"),
        F.when(k % 9 == 0, 0).otherwise(100).cast("long").alias("timesteps"))


@query("S2 V5 V6 V29", """
    SELECT id, rule FROM (
      SELECT c_custkey AS id, UNNEST(list_filter([
        CASE WHEN c_custkey % 12 = 0 THEN 'confidence_score_range' END, CASE WHEN c_custkey % 12 = 1 THEN 'segmentation_score_range' END,
        CASE WHEN c_custkey % 12 = 2 THEN 'topology_score_range' END, CASE WHEN c_custkey % 12 = 3 THEN 'edge_alignment_score_range' END,
        CASE WHEN c_custkey % 12 = 4 THEN 'deviation_from_baseline_score_range' END, CASE WHEN c_custkey % 31 = 0 THEN 'parcel_id_uuid' END,
        CASE WHEN c_custkey % 5 = 0 THEN 'policy_sha256_length' END, CASE WHEN c_custkey % 9 = 0 THEN 'timesteps_positive' END,
        CASE WHEN c_custkey % 7 = 0 THEN 'explanation_length' END, CASE WHEN c_custkey % 37 = 0 THEN 'demo_refused' END],
        lambda x: x IS NOT NULL)) AS rule FROM customer)""")
def payload_contract(spark, sf):
    return K.violations(_payload_docs(spark, sf), ["id"], K.payload_rules())


@query("V6 F18 F19", """
    SELECT c_custkey AS id, lower(CAST(c_custkey AS VARCHAR)) AS name, sha256(CAST(c_custkey AS VARCHAR)) AS digest,
           substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-'
             || lower(to_hex(8 + CAST('0x' || substring(h, 17, 1) AS INTEGER) % 4)) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS parcel_uuid
    FROM (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('v2:' || CAST(c_custkey AS VARCHAR) || ':{}')) AS h FROM customer)""")
def candidate_ids(spark, sf):
    k = F.col("c_custkey")
    made = I.candidate_id(F.lit("v2"), k, F.lit("{}"))
    return D.table(spark, sf, "customer").select(
        k.alias("id"), k.cast("string").alias("name"), I.content_hash(k.cast("string")).alias("digest"),
        I.canonical_uuid(F.upper(F.regexp_replace(made, "-", ""))).alias("parcel_uuid"))


@query("V7", "SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS id, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return K.duplicates(D.table(spark, sf, "lineitem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"))


def _companions(spark, sf):
    layer = D.parcel_layer(spark, sf).select("id", "rings")
    features = layer.where(F.col("id") % 11 != 0)
    moved = F.when(F.col("id") % 13 == 0, 1e-6).otherwise(1e-14)
    payload = layer.where(F.col("id") % 7 != 0).withColumn("rings", G.map_points("rings", lambda x, y: G.point(x + moved, y)))
    return features, payload


@query("J16 U3", """
    SELECT CASE WHEN id % 7 = 0 THEN 'missing_metadata' WHEN id % 11 = 0 THEN 'missing_geometry' ELSE 'geometry_mismatch' END AS kind, id
    FROM v_lattice WHERE (id % 7 = 0 AND id % 11 <> 0) OR (id % 11 = 0 AND id % 7 <> 0) OR (id % 13 = 0 AND id % 7 <> 0 AND id % 11 <> 0)""")
def companion_mismatches(spark, sf):
    return K.companion_report(*_companions(spark, sf))


@query("O6 J16", "SELECT 'missing_metadata' AS kind, id FROM v_lattice WHERE id % 7 = 0 AND id % 11 <> 0 ORDER BY id LIMIT 10")
def first_missing_ids(spark, sf):
    return K.first_ids(K.companion_report(*_companions(spark, sf)), "missing_metadata")


@query("U3 U4", """
    SELECT 'left_only' AS side, parcel_id FROM (SELECT DISTINCT parcel_id FROM v_evidence) WHERE parcel_id NOT IN (SELECT parcel_id FROM v_parcels)
    UNION ALL
    SELECT 'right_only', parcel_id FROM v_parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM v_evidence)""")
def evidence_id_differences(spark, sf):
    return K.id_differences(D.evidence(spark, sf), D.parcels(spark, sf), "parcel_id")


@query("J24", """
    SELECT 'project_not_empty' AS rule, CAST(project_id AS VARCHAR) AS id FROM (SELECT DISTINCT project_id FROM v_parcels)
    UNION ALL SELECT 'parcel_stored', CAST(parcel_id AS VARCHAR) FROM v_parcels""")
def import_guards(spark, sf):
    parcels = D.parcels(spark, sf)
    incoming = parcels.select(F.col("project_id"), F.col("parcel_id")).unionByName(
        parcels.select((F.col("project_id") + 1_000_000).alias("project_id"), (F.col("parcel_id") + 1_000_000_000).alias("parcel_id")))
    return K.occupied_projects(incoming, parcels.select("project_id", "parcel_id"))


@query("J25", "SELECT queue_id, assigned_to FROM v_queue WHERE assigned_to IS NOT NULL AND assigned_to NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_assignees(spark, sf):
    return K.unknown_assignees(D.survey_queue(spark, sf), D.users(spark, sf)).select("queue_id", "assigned_to")


@query("V20", f"""
    SELECT CAST(parcel_id AS VARCHAR) AS id, UNNEST(list_filter([CASE WHEN training_role IS NULL THEN 'role_unsupported' END,
             CASE WHEN training_role = 'hard_negative' AND parcel_id % 2 = 0 THEN 'negative_without_class' END], lambda x: x IS NOT NULL)) AS rule
    FROM ({_OUTCOME})""")
def review_export_contract(spark, sf):
    rows = _outcomes(spark, sf).withColumn(
        "false_positive_class", F.when(F.col("parcel_id") % 2 == 1, F.col("false_positive_class")))
    head = spark.range(1).select(F.lit("labels.v1").alias("schema_version"), F.lit("FeatureCollection").alias("type"))
    return K.review_export_violations(head, rows, "labels.v1")


@query("V29", """
    SELECT CAST(queue_id AS VARCHAR) AS id, 'priority_range' AS rule FROM v_queue WHERE priority_score * 1.5 > 1
    UNION ALL SELECT CAST(queue_id AS VARCHAR), 'assigned_without_user' FROM v_queue WHERE status = 'assigned' AND queue_id % 3 = 0
    UNION ALL SELECT 'p' || CAST(parcel_id AS VARCHAR), 'confidence_range' FROM v_parcels WHERE confidence * 1.2 > 1
    UNION ALL SELECT 'p' || CAST(parcel_id AS VARCHAR), 'version_positive' FROM v_parcels WHERE version - 1 < 1""")
def handoff_contracts(spark, sf):
    queue = D.survey_queue(spark, sf).withColumn("priority_score", F.col("priority_score") * 1.5).withColumn(
        "assigned_to", F.when(F.col("queue_id") % 3 != 0, F.col("assigned_to")))
    parcels = D.parcels(spark, sf).withColumn("confidence", F.col("confidence") * 1.2).withColumn("version", F.col("version") - 1)
    q = K.violations(queue, [F.col("queue_id").cast("string").alias("id")], K.queue_rules())
    p = K.violations(parcels, [F.concat(F.lit("p"), F.col("parcel_id").cast("string")).alias("id")], K.parcel_response_rules())
    return q.unionByName(p)


@query("V29 V6", """
    SELECT parcel_id AS id, UNNEST(list_filter([CASE WHEN parcel_id % 7 = 0 THEN 'geometry_type' END, CASE WHEN parcel_id % 5 = 0 THEN 'id_uuid' END,
        CASE WHEN status = 'rejected' THEN 'status_enum' END, CASE WHEN confidence * 1.2 > 1 THEN 'confidence_range' END], lambda x: x IS NOT NULL)) AS rule
    FROM v_parcels""")
def feature_contract(spark, sf):
    k = F.col("parcel_id")
    uuid = F.format_string("00000000-0000-4000-8000-%012d", k)
    layer = D.parcel_layer(spark, sf).select(F.col("id").alias("parcel_id"), "rings").join(D.parcels(spark, sf), "parcel_id")
    properties = F.struct(
        F.when(k % 5 != 0, uuid).otherwise(F.lit("x")).alias("id"), F.format_string("00000000-0000-4000-9000-%012d", F.col("project_id")).alias("project_id"),
        "source", F.when(F.col("status") == "rejected", "gone").otherwise(F.col("status")).alias("status"),
        (F.col("confidence") * 1.2).alias("confidence_score"), F.col("health").alias("health_score"), "version")
    geometry = F.struct(F.when(k % 7 == 0, "LineString").otherwise("Polygon").alias("type"), G.to_coordinates("rings").alias("coordinates"))
    rows = layer.select(k.alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("feature"))
    return K.violations(rows, ["id"], K.feature_rules())


@query("V29 F17", """
    SELECT parcel_id AS id, UNNEST(list_filter([CASE WHEN bool_or(component = 'rl_refinement') THEN 'component_enum' END,
        CASE WHEN bool_or(score * 1.5 > 1) THEN 'component_score_range' END, CASE WHEN parcel_id % 9 = 0 THEN 'component_text_missing' END,
        CASE WHEN parcel_id % 4 = 0 THEN 'explanation_missing' END], lambda x: x IS NOT NULL)) AS rule
    FROM v_newest_evidence GROUP BY parcel_id""")
def explanation_contract(spark, sf):
    k = F.col("parcel_id")
    newest = D.evidence(spark, sf).groupBy("parcel_id", "component").agg(
        F.max_by("score", F.struct("created_at", "batch", "line", "score")).alias("score"))
    # one row per parcel and component, so the list of a parcel has at most five entries
    listed = newest.groupBy("parcel_id").agg(F.collect_list(F.struct(
        "component", (F.col("score") * 1.5).alias("score"), F.when(k % 9 != 0, "text").alias("explanation"))).alias("components"))
    rows = listed.select(
        k.alias("id"), F.format_string("00000000-0000-4000-8000-%012d", k).alias("parcel_id"), F.when(k % 4 != 0, "text").alias("explanation"), "components")
    return K.violations(rows, ["id"], K.explanation_rules())


@query("V29", """
    SELECT id, rule FROM (SELECT id, UNNEST(list_filter([CASE WHEN id % 9 = 0 THEN 'class_enum' END, CASE WHEN id % 8 = 0 THEN 'raw_confidence_range' END,
      CASE WHEN id % 7 = 0 THEN 'source_tile_id_missing' END, CASE WHEN id % 9 <> 0 AND id % 5 = 0 THEN 'parcel_id_missing' END], lambda x: x IS NOT NULL)) AS rule
    FROM v_lattice)""")
def segmentation_contract(spark, sf):
    k = F.col("id")
    rows = D.parcel_layer(spark, sf).select(
        "id", F.when(k % 9 == 0, "tree").otherwise("parcel").alias("class"), F.when(k % 8 == 0, 1.5).otherwise(0.5).alias("raw_confidence"),
        F.when(k % 7 != 0, "t").alias("source_tile_id"), F.when(k % 5 != 0, "p").alias("parcel_id"))
    return K.violations(rows, ["id"], K.segmentation_rules())


@query("S13", """
    SELECT count(*) AS parcel_count, true AS counts_equal, count(*) FILTER (WHERE id % 50 = 0) = 0 AS ids_aligned, false AS scores_in_range,
           true AS all_valid, count(*) AS unique_parcel_ids, true AS ids_unique FROM v_lattice""")
def output_set_consistency(spark, sf):
    layer = D.parcel_layer(spark, sf).select(F.col("id").alias("position"), F.col("id").cast("string").alias("parcel_id"), "rings")
    scores = _payload_docs(spark, sf).select(F.col("id").alias("position"), *K.SCORES)
    refined = layer.withColumn("parcel_id", F.when(F.col("position") % 50 == 0, "other").otherwise(F.col("parcel_id")))
    return K.output_consistency(layer.select("position"), refined, layer.join(scores, "position"))


@query("S8", """
    SELECT doc_id AS osm_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN 'building' WHEN doc_id % 4 = 1 THEN 'road' WHEN doc_id % 4 = 2 THEN 'canal' END AS feature_type,
           CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 3 END AS positions
    FROM documents WHERE (doc_id % 4 = 0 AND doc_id % 3 <> 0) OR doc_id % 4 IN (1, 2)""")
def map_features(spark, sf):
    from ..sources.documents import osm_features

    k = F.col("doc_id")
    tag = F.element_at(F.array(*[F.lit(t) for t in ("building", "highway", "waterway", "natural")]), (k % 4 + 1).cast("int"))
    pt = lambda y, x: F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon"))
    loop = F.array(pt(0, 0), pt(0, 1), pt(1, 1), pt(1, 0), pt(0, 0))
    unclosed = F.array(pt(0, 0), pt(0, 1), pt(1, 1), pt(1, 0), pt(2, 2))
    line = F.array(pt(0, 0), pt(0, 1), pt(2, 2))
    elements = D.table(spark, sf, "documents").select(
        k.alias("id"), F.create_map(tag, F.lit("yes")).alias("tags"),
        F.when((k % 4 == 0) & (k % 3 == 0), unclosed).when(k % 4 == 0, loop).otherwise(line).alias("geometry"))
    return osm_features(elements).select("osm_id", "feature_type", F.size("line").alias("positions"))
