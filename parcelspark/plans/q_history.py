"""Registered queries: history, discrepancy, layer analysis."""

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import history as H
from ..sources import domain as D
from .analysis import analyze_layer, score_rows, write_back
from .registry import query

R6 = lambda c: F.round(c, 6)
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


@query("A9 W1", "SELECT parcel_id, round(volatility, 6) AS volatility FROM v_volatility")
def historical_volatility(spark, sf):
    return H.historical_volatility(D.parcel_versions(spark, sf)).withColumn("volatility", R6("volatility"))


@query("W1", """
    SELECT version_id, parcel_id, round(lag(area_sqm) OVER (PARTITION BY parcel_id ORDER BY captured_at, version_id), 6) AS prev_area_sqm
    FROM v_versions""")
def previous_areas(spark, sf):
    return H.with_previous_area(D.parcel_versions(spark, sf)).select("version_id", "parcel_id", R6("prev_area_sqm").alias("prev_area_sqm"))


_CHANGES = """
    SELECT parcel_id, version_id, strftime(captured_at, '%Y-%m-%d') AS captured_on,
           round(least(1.0, r), 4) AS normalized_discrepancy, round(r, 4) AS area_change_ratio,
           CASE WHEN least(1.0, r) >= 0.6 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT *, abs(area_sqm - prev) / greatest(prev, 1e-9) AS r FROM (
            SELECT *, lag(area_sqm) OVER (PARTITION BY parcel_id ORDER BY captured_at, version_id) AS prev FROM v_versions)
          WHERE prev IS NOT NULL)"""


@query("W2", _CHANGES)
def version_changes(spark, sf):
    return H.version_changes(D.parcel_versions(spark, sf)).withColumn("captured_on", DAY("captured_at")).select(
        "parcel_id", "version_id", "captured_on", "normalized_discrepancy", "area_change_ratio", "severity")


@query("J1 W3", """
    SELECT p.parcel_id, l.version_id, strftime(l.captured_at, '%Y-%m-%d') AS captured_on, l.source
    FROM v_parcels p LEFT JOIN v_latest_version l USING (parcel_id)""")
def latest_versions(spark, sf):
    latest = H.latest_version(D.parcel_versions(spark, sf), ["version_id", "captured_at", "source"])
    return D.parcels(spark, sf).select("parcel_id").join(latest, "parcel_id", "left").select(
        "parcel_id", "version_id", DAY("captured_at").alias("captured_on"), "source")


@query("J27 O3", "SELECT parcel_id, version_id, strftime(captured_at, '%Y-%m-%d') AS captured_on, source FROM v_versions")
def parcel_history(spark, sf):
    return H.history_rows(D.parcel_versions(spark, sf), ["version_id", "captured_at", "source"]).select(
        "parcel_id", "version_id", DAY("captured_at").alias("captured_on"), "source")


@query("J2 F16 G8 G9", """
    SELECT p.id AS parcel_id, v.version_id, round(p.area, 6) AS current_area, round(v.historical_area, 6) AS historical_area,
           round(v.current_area + v.historical_area - 2 * v.inter_area, 6) AS boundary_difference,
           round(v.current_area - v.historical_area, 6) AS area_difference,
           round(100 * (v.current_area - v.historical_area) / v.historical_area, 6) AS area_difference_percent
    FROM v_parcel_area p LEFT JOIN (
      SELECT * FROM v_version_overlay WHERE current_area + historical_area - 2 * inter_area > 1e-6
      QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY captured_at DESC, version_id DESC) = 1) v ON v.parcel_id = p.id""")
def latest_different_version(spark, sf):
    rows = H.latest_different_version(D.parcel_layer(spark, sf), D.version_layer(spark, sf))
    names = ["current_area", "historical_area", "boundary_difference", "area_difference", "area_difference_percent"]
    return rows.select("parcel_id", "version_id", *[R6(n).alias(n) for n in names])


@query("F2 G12", """
    SELECT parcel_id, round(least(1.0, raw), 4) AS normalized_discrepancy, round(ratio, 4) AS area_difference_ratio,
           round(sym, 4) AS boundary_difference_ratio, round(shift, 3) AS centroid_shift_m,
           CASE WHEN raw >= 0.6 THEN 'high' WHEN raw >= 0.3 THEN 'medium' ELSE 'low' END AS severity
    FROM v_discrepancy""")
def layer_discrepancy(spark, sf):
    rows = H.latest_discrepancy(D.parcel_layer(spark, sf).select("id", "rings"), D.version_layer(spark, sf))
    return rows.withColumnRenamed("id", "parcel_id").select(
        "parcel_id", "normalized_discrepancy", "area_difference_ratio", "boundary_difference_ratio", "centroid_shift_m", "severity")


_SCORED = """
    SELECT *, CASE WHEN health_score >= 0.85 THEN 'high' WHEN health_score >= 0.60 THEN 'medium' ELSE 'low' END AS health_band,
           round(0.40 * (1 - c) + 0.25 * d + 0.15 * v + 0.10 * least(1.0, n / 3.0) + 0.10 * t::INT, 4) AS priority_score,
           CASE WHEN reasons = '' THEN 'low-risk parcel; routine review' ELSE reasons END AS reason
    FROM (SELECT *, concat_ws(', ', CASE WHEN c < 0.60 THEN 'low confidence' END, CASE WHEN d >= 0.30 THEN 'historical/record discrepancy' END,
                   CASE WHEN v >= 0.50 THEN 'historical instability' END, CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' anomaly(s)' END,
                   CASE WHEN t THEN 'topology violation' END) AS reasons
          FROM (SELECT *, round(0.4 * c + 0.2 * (1 - t::INT) + 0.2 * (1 - d) + 0.2 * (1 - v), 4) AS health_score,
                       (c < 0.60)::INT + (d >= 0.30)::INT + t::INT + (v >= 0.50)::INT AS n
                FROM (SELECT p.parcel_id, p.project_id, coalesce(p.confidence, 0) AS c, coalesce(round(least(1.0, x.raw), 4), 0) AS d,
                             coalesce(g.topology_violation, false) AS t, coalesce(w.volatility, 0) AS v
                      FROM v_parcels p LEFT JOIN v_discrepancy x USING (parcel_id)
                      LEFT JOIN v_topology g ON g.id = p.parcel_id LEFT JOIN v_volatility w USING (parcel_id))))"""


def _analysis(spark, sf):
    return analyze_layer(D.parcels(spark, sf), D.parcel_layer(spark, sf), D.parcel_versions(spark, sf), D.version_layer(spark, sf))


@query("F8 F1 F4 F6 F7 J3 J4 G11", f"""
    SELECT parcel_id, project_id, round(c, 6) AS confidence, t AS topology_violation, round(v, 4) AS historical_volatility,
           d AS normalized_discrepancy, health_score, health_band, n AS anomaly_count, priority_score, reason
    FROM ({_SCORED})""")
def parcel_analysis(spark, sf):
    return _analysis(spark, sf).select(
        "parcel_id", "project_id", R6("confidence").alias("confidence"), "topology_violation",
        F.round("volatility", 4).alias("historical_volatility"), "normalized_discrepancy", "health_score", "health_band",
        "anomaly_count", "priority_score", "reason")


@query("F4 T7", f"""
    SELECT 'run-1' AS run_id, parcel_id, a.type, a.m AS magnitude FROM (
      SELECT parcel_id, UNNEST(list_filter([
        CASE WHEN c < 0.60 THEN {{'type': 'boundary_shift', 'm': round(1 - c, 4)}} END,
        CASE WHEN d >= 0.30 THEN {{'type': 'boundary_shift', 'm': round(d, 4)}} END,
        CASE WHEN t THEN {{'type': 'topology_break', 'm': 1.0::DOUBLE}} END,
        CASE WHEN v >= 0.50 THEN {{'type': 'encroachment', 'm': round(v, 4)}} END], lambda x: x IS NOT NULL)) AS a
      FROM ({_SCORED}))""")
def analysis_anomalies(spark, sf):
    return write_back(_analysis(spark, sf), "run-1").anomalies.select("run_id", "parcel_id", "type", "magnitude")


@query("T7 F6 F7", f"SELECT 'run-1' AS run_id, parcel_id, priority_score, reason, 'pending' AS status FROM ({_SCORED})")
def analysis_queue(spark, sf):
    return write_back(_analysis(spark, sf), "run-1").queue


@query("F1 F4 F6 F7", """
    SELECT parcel_id, round(0.4 * c + 0.2 + 0.2 + 0.2 * (1 - v), 4) AS health_score,
           (c < 0.60)::INT + (v >= 0.50)::INT AS anomaly_count,
           round(0.40 * (1 - c) + 0.15 * v + 0.10 * least(1.0, ((c < 0.60)::INT + (v >= 0.50)::INT) / 3.0), 4) AS priority_score
    FROM (SELECT p.parcel_id, coalesce(confidence, 0) AS c, coalesce(w.volatility, 0) AS v
          FROM v_parcels p LEFT JOIN v_volatility w USING (parcel_id))""")
def history_only_scores(spark, sf):
    rows = D.parcels(spark, sf).select("parcel_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).join(
        H.historical_volatility(D.parcel_versions(spark, sf)), "parcel_id", "left").fillna({"volatility": 0.0})
    rows = rows.withColumn("normalized_discrepancy", F.lit(0.0)).withColumn("topology_violation", F.lit(False))
    return score_rows(rows).select("parcel_id", "health_score", "anomaly_count", "priority_score")


@query("A29", """
    SELECT p.parcel_id, count(a.anomaly_id) AS anomaly_count, round(least(1.0, count(a.anomaly_id) / 3.0), 6) AS anomaly_risk
    FROM v_parcels p LEFT JOIN v_anomalies a USING (parcel_id) GROUP BY 1""")
def anomaly_risk(spark, sf):
    counts = D.anomalies(spark, sf).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return D.parcels(spark, sf).select("parcel_id").join(counts, "parcel_id", "left").fillna(0, ["anomaly_count"]).withColumn(
        "anomaly_risk", R6(F.least(F.lit(1.0), F.col("anomaly_count") / 3.0)))
