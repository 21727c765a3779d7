import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import RINGS, square, to_rings
from parcelspark.operators import contracts as K
from parcelspark.operators import readiness as Y
from parcelspark.operators.replay import Replay
from parcelspark.plans.imports import import_features, import_payload
from parcelspark.operators.raster import check_kernel
from parcelspark.plans.vectorize import Config, baseline_grid, detailed_grid, fused_grid
from parcelspark.sources import documents as D
from parcelspark.sources import sinks as W
from parcelspark.streaming import events as E

TRIANGLE = [[[85, 23], [85.001, 23], [85.001, 23.001], [85, 23]]]


def feature(properties, coordinates=TRIANGLE, kind="Polygon"):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


def test_feature_collection_import(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        feature({"raw_confidence": 0.8, "source_tile_id": "t1"}), feature({"raw_confidence": True}),
        feature({}), feature({"class": "building"}), feature({"raw_confidence": "0.5"}), feature({"raw_confidence": None})]}
    (tmp_path / "in.geojson").write_text(json.dumps(doc))
    rows = D.segmentation_columns(D.read_features(spark, str(tmp_path / "in.geojson"))).withColumn(
        "id", F.col("position")).withColumn("project_id", F.lit(0))
    parcels, evidence, refused = import_features(rows)
    sources = {r.id: r.source for r in parcels.collect()}
    assert sources == {0: "ai_extracted", 1: "ai_extracted", 2: "existing_gis", 4: "ai_extracted", 5: "ai_extracted"}
    assert [(r.parcel_id, r.score) for r in evidence.collect()] == [(0, 0.8)]
    assert [r.id for r in refused.collect()] == [3]
    assert 5000 < parcels.first().area_sqm < 6000


@pytest.mark.parametrize("geometry,rule", [
    ({"type": "Point", "coordinates": [[[85, 23]]]}, "polygon_required"),
    ({"type": "Polygon", "coordinates": []}, "polygon_required"),
    ({"type": "Polygon", "coordinates": [[[200, 23], [200.1, 23], [200.1, 23.1], [200, 23]]]}, "lon_lat_range"),
    ({"type": "Polygon", "coordinates": TRIANGLE}, None),
])
def test_polygon_contract(spark, geometry, rule):
    from parcelspark.functions.geometry import from_coordinates

    df = spark.createDataFrame([(geometry["type"], [[[float(v) for v in p] for p in r] for r in geometry["coordinates"]])],
                               "type string, coordinates array<array<array<double>>>")
    rules = K.polygon_rules(F.col("type"), F.col("coordinates"), from_coordinates("coordinates"))
    assert [r.rule for r in K.violations(df, ["type"], rules).collect()] == ([rule] if rule else [])


def payload(i, **changes):
    base = {
        "parcel_id": f"{i:032X}", "geometry": {"type": "Polygon", "coordinates": TRIANGLE}, "confidence_score": 0.9,
        "segmentation_score": 0.8, "topology_score": 1.0, "edge_alignment_score": 0.7, "deviation_from_baseline_score": 0.6,
        "explanation": "moved", "demo": False,
        "metadata": {"baseline_geometry": {"type": "Polygon", "coordinates": TRIANGLE}, "policy_sha256": "a" * 64,
                     "timesteps": 20000, "accepted": True, "changed": False}}
    return {**base, **changes}


def test_payload_import_and_rules(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([payload(1), payload(2, confidence_score=1.2, demo=True)]))
    rows = D.read_payload(spark, str(tmp_path / "p.json"))
    assert {(r.parcel_id[-1], r.rule) for r in K.violations(rows, ["parcel_id"], K.payload_rules()).collect()} == {
        ("2", "confidence_score_range"), ("2", "demo_refused")}
    good = rows.where("NOT demo").withColumn("project_id", F.lit("p"))
    out = import_payload(good, F.lit("2024-01-01").cast("timestamp"))
    p = out.parcels.first()
    assert (p.status, p.health_score, p.id) == ("ai_processed", 0.96, "00000000-0000-0000-0000-000000000001")
    texts = {r.component: r.explanation for r in out.evidence.collect()}
    assert texts["rl_refinement"] == "PPO policy aaaaaaaaaaaa ran for 20,000 timesteps; candidate accepted=true, changed=false. moved"
    assert out.queue.first().reason == "low-risk parcel; routine review" and out.anomalies.count() == 0
    assert out.versions.first().source == "vectorization_before_rl"


def test_manifests_reports_and_osm(spark, tmp_path):
    records = [{"name": f"w{i}", "split": s, "bounds": [0, 0, 1, 1], "hard_negative_counts": {"road": i}}
               for i, s in enumerate(["train"] * 9 + ["validation"] * 3 + ["test"] * 3)]
    (tmp_path / "m.json").write_text(json.dumps({"records": records, LEGACY: False}))
    head, rows = D.read_manifest(spark, str(tmp_path / "m.json"))
    found = Y.manifest_findings(head, rows, ["manifest"]).collect()
    assert [f.level for f in found] == ["warning"]
    assert Y.merge_counts(rows, ["manifest"]).first().features == sum(range(15))
    (tmp_path / "one.json").write_text(json.dumps({"name": "aoi", "image": "a.tif", "crs": "EPSG:1"}))
    _, single = D.read_manifest(spark, str(tmp_path / "one.json"))
    assert [(r.name, r.image) for r in single.collect()] == [("aoi", "a.tif")]
    (tmp_path / "r.json").write_text(json.dumps({"invalid_after": 0, "overlap_pairs_after": 2, "alignment_after": 0.5}))
    assert D.read_report(spark, str(tmp_path / "r.json"), "refinement").first().overlap_pairs_after == 2
    pts = [{"lat": 0, "lon": 0}, {"lat": 0, "lon": 1}, {"lat": 1, "lon": 1}, {"lat": 0, "lon": 0}]
    elements = [{"id": 1, "tags": {"building": "yes"}, "geometry": pts}, {"id": 2, "tags": {"building": "yes"}, "geometry": pts[:3]},
                {"id": 3, "tags": {"highway": "x"}, "geometry": pts[:2]}, {"id": 4, "tags": {"waterway": "x"}, "geometry": pts[:1]}]
    (tmp_path / "osm.json").write_text(json.dumps({"elements": elements}))
    assert [(r.osm_id, r.feature_type) for r in D.read_osm(spark, str(tmp_path / "osm.json")).orderBy("osm_id").collect()] == [(1, "building"), (3, "road")]
    assert D.file_hashes(spark, str(tmp_path / "r.json")).count() == 1


LEGACY = "target_aoi_used_for_training_or_selection"


def test_feature_sink_round_trip_and_no_overwrite(spark, make_layer, tmp_path):
    layer = make_layer([(0, 1, [square(0, 0, 1)]), (0, 2, [square(5, 5, 2)])])
    path = str(tmp_path / "out")
    W.write_features(W.feature_rows(layer, ["id"]), path, {"name": "n"})
    back = D.read_feature_lines(spark, path + "/features")
    assert back.count() == 2 and back.where(F.col("rings").isNotNull()).count() == 2
    header = json.loads(spark.read.text(path + "/header").first().value)
    assert header["crs"] == W.CRS84 and header["type"] == "FeatureCollection"
    W.write_features(W.feature_rows(layer.limit(0), ["id"]), str(tmp_path / "empty"))
    W.write_versioned(layer, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="(?i)exist"):
        W.write_versioned(layer, str(tmp_path / "v"), "1")


def test_config_grids():
    assert len(baseline_grid()) == 64 and len(fused_grid()) == 25
    near = detailed_grid(baseline_grid()[0])
    assert len(near) == len(set(near)) == 24
    with pytest.raises(ValueError):  # each operator checks the settings it uses
        check_kernel(Config(close_pixels=4).close_pixels, 0)


def stream_base(spark):
    old = to_rings(square(0, 0, 10))
    parcels = spark.createDataFrame(
        [(1, 0, old, "ai_extracted", "needs_review", 0.9, 0.8, "forest", 1), (2, 0, old, "ai_extracted", "needs_review", 0.9, 0.8, "forest", 1)],
        f"parcel_id long, project_id long, rings {RINGS}, source string, status string, confidence double, health double, land_use string, version int")
    evidence = spark.createDataFrame([(1, "topology", 0.5, "goes"), (2, "topology", 0.5, "stays")], "parcel_id long, component string, score double, explanation string")
    queue = spark.createDataFrame(
        [(1, 1, "pending", None, datetime(2024, 1, 1)), (2, 2, "pending", None, datetime(2024, 1, 1))],
        "queue_id long, parcel_id long, status string, assigned_to long, created_at timestamp")
    return Replay(parcels, None, None, None, evidence, queue, None)


def event(number, parcel, day_, kind, correction=None, rings=None, queue=None, who=None):
    at = datetime(2024, 1, day_) if isinstance(day_, int) else day_
    return (number, parcel, at, kind, correction, None, rings, None, None, queue, who)


def pushed(spark, tmp_path, batches):
    src, root, chk = (str(tmp_path / n) for n in ("src", "root", "chk"))
    base = stream_base(spark)
    users = spark.createDataFrame([(7, "a"), (8, "b")], "user_id long, name string")
    for rows in batches:
        spark.createDataFrame(list(rows), E.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        E.replay_stream(E.read_events(spark, src), chk, root, lambda: base, lambda: users).awaitTermination()
    return root, base


def test_review_event_stream_is_idempotent(spark, tmp_path):
    first = event(1, 1, 2, "patch", rings=to_rings(square(0, 0, 20)))
    root, base = pushed(spark, tmp_path, [[first], [first, event(2, 1, 3, "verify", "boundary_adjust")]])
    row = E.current(spark, root, "parcels").where("parcel_id = 1").first()
    # the repeated event id is dropped: one patch and one decision
    assert (row.status, row.version, row.area_sqm, row.source) == ("verified", 3, 400, "field_verified")
    assert E.current(spark, root, "queue").where("parcel_id = 1").first().status == "completed"
    whole = {r.parcel_id: r.status for r in E.current(spark, root, "queue", base.queue).collect()}
    assert whole == {1: "completed", 2: "pending"}
    assert [r.explanation for r in E.current(spark, root, "evidence", base.evidence).collect()] == ["stays"]


def test_late_events_and_assignments_keep_their_order(spark, tmp_path):
    verify = event(1, 1, datetime(2024, 1, 2, 12), "verify", "boundary_adjust")
    late = event(2, 1, datetime(2024, 1, 2, 6), "verify", "reject")
    root, base = pushed(spark, tmp_path, [
        [verify, event(3, None, 2, "assign", queue=2, who=7)],
        [late, verify, event(4, None, 3, "assign", queue=1, who=7), event(5, None, 3, "assign", queue=2, who=99), event(6, None, 3, "assign", queue=50, who=7)],
    ])
    row = E.current(spark, root, "parcels").where("parcel_id = 1").first()
    assert (row.status, row.version) == ("verified", 3)  # the reject came before, though it arrived later
    queue = {r.queue_id: (r.status, r.assigned_to) for r in E.current(spark, root, "queue", base.queue).collect()}
    assert queue == {1: ("completed", None), 2: ("assigned", 7)}
    refused = {r.event_id for r in spark.read.parquet(root + "/refused").collect()}
    assert refused == {4, 5, 6}


def test_anomaly_count_stream(spark, tmp_path):
    rows = [(1, "overlap", datetime(2024, 1, 1, 5)), (2, "overlap", datetime(2024, 1, 1, 9)), (1, "overlap", datetime(2024, 1, 5))]
    spark.createDataFrame(rows, "parcel_id long, type string, detected_at timestamp").write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema("parcel_id long, type string, detected_at timestamp").parquet(str(tmp_path / "a"))
    q = E.daily_anomaly_counts(stream).writeStream.format("memory").queryName("daily").outputMode("append").trigger(
        availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r.window_start.day, r.events) for r in spark.table("daily").collect()] == [(1, 2)]
