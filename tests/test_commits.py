"""Tables that appear together: reruns, crashes and refused imports."""

import pytest
from parcelspark.functions.geometry import RINGS_TYPE
from parcelspark.plans import jobs
from parcelspark.plans.jobs import ImportRefused, analysis_job, import_job
from parcelspark.sources import commits
from parcelspark.sources.commits import AlreadyCommitted, begin, read_together, versions, write_together
from pyspark.sql import functions as F

from conftest import square, to_rings


def frame(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def test_versions_are_written_once_and_read_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    write_together(root, "one", {"a": frame(spark, 3), "b": frame(spark, 0)})
    write_together(root, "two", {"a": frame(spark, 5)})
    one = read_together(spark, root, "one")
    assert {n: t.count() for n, t in one.items()} == {"a": 3, "b": 0} and one["b"].columns == ["id", "v"]
    assert read_together(spark, root, "two")["a"].count() == 5
    with pytest.raises(AlreadyCommitted):
        write_together(root, "one", {"a": frame(spark, 9)})
    assert read_together(spark, root, "one")["a"].count() == 3
    assert sorted((r.version, r.tables) for r in versions(spark, root).collect()) == [("one", 2), ("two", 1)]
    for bad in ("", " x", "a/b", "_x", "*"):
        with pytest.raises(ValueError):
            begin(spark, root, bad)


def test_a_crash_leaves_nothing_visible_and_the_version_free(spark, tmp_path):
    root = str(tmp_path / "out")
    broken = frame(spark, 4).withColumn("v", F.raise_error(F.lit("no more")).cast("int"))
    with pytest.raises(Exception, match="no more"):
        write_together(root, "one", {"a": frame(spark, 3), "b": broken})
    assert versions(spark, root).isEmpty()
    with pytest.raises(LookupError):
        read_together(spark, root, "one")
    # a manifest whose writer died has a folder without a finished file
    (tmp_path / "out" / "_commits" / "one" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "out" / "_commits" / "one" / "_temporary" / "0" / "part-0.json").write_text('{"version":"one","name":"a","path":"x"}')
    with pytest.raises(LookupError):
        read_together(spark, root, "one")
    write_together(root, "one", {"a": frame(spark, 3), "b": frame(spark, 2)})
    assert {n: t.count() for n, t in read_together(spark, root, "one").items()} == {"a": 3, "b": 2}


def test_two_attempts_at_one_version(spark, tmp_path):
    root = str(tmp_path / "out")
    first, second = begin(spark, root, "v"), begin(spark, root, "v")
    first.write("t", frame(spark, 1))
    second.write("t", frame(spark, 2))
    second.commit(["t"])
    with pytest.raises(AlreadyCommitted):
        first.commit(["t"])
    assert read_together(spark, root, "v")["t"].count() == 2


PAYLOAD = (f"id string, project_id long, rings {RINGS_TYPE}, baseline_rings {RINGS_TYPE}, confidence_score double, segmentation_score double, "
           "topology_score double, edge_alignment_score double, deviation_from_baseline_score double, explanation string, "
           "policy_sha256 string, timesteps long, accepted boolean, changed boolean")


def payload_row(key, project=1, score=0.5, topology=1.0, dx=0.0):
    near = to_rings([(85 + x * 1e-5, 23 + y * 1e-5) for x, y in square(0, 0, 20)])
    old = to_rings([(85 + (x + dx) * 1e-5, 23 + y * 1e-5) for x, y in square(0, 0, 20)])
    return (key, project, near, old, score, 0.5, topology, 0.5, 0.5, "Moved.", "a" * 64, 20, True, False)


def stores(spark):
    parcels = spark.createDataFrame([("old", 2)], "parcel_id string, project_id long")
    return parcels, spark.createDataFrame([(1,), (2,)], "project_id long")


def test_import_is_one_pass_and_all_or_nothing(spark, tmp_path, monkeypatch):
    root, at = str(tmp_path / "in"), F.lit("2024-01-01").cast("timestamp")
    good = spark.createDataFrame([payload_row("a"), payload_row("b", score=0.9, topology=0.9, dx=9)], PAYLOAD)
    bad = spark.createDataFrame(
        [payload_row("a"), payload_row("a"), payload_row("old", project=2), payload_row("c", project=3, score=1.5)], PAYLOAD)
    parcels, projects = stores(spark)
    with pytest.raises(ImportRefused) as refused:
        import_job(bad, parcels, projects, root, "one", at)
    assert refused.value.counts == {
        "project_not_empty": 1, "parcel_stored": 1, "project_missing": 1, "parcel_repeated": 1, "confidence_score_range": 1}
    assert versions(spark, root).isEmpty() and not (tmp_path / "in").exists()

    # the queue cannot be written: nothing of the import shows
    whole = commits.Attempt.write
    monkeypatch.setattr(commits.Attempt, "write", lambda self, name, df, *rest: whole(self, name, df.select("nothing") if name == "queue" else df, *rest))
    with pytest.raises(Exception, match="nothing"):
        import_job(good, parcels, projects, root, "one", at)
    assert versions(spark, root).isEmpty()
    monkeypatch.setattr(commits.Attempt, "write", whole)

    passes, scored = [], jobs.score_payload
    monkeypatch.setattr(jobs, "score_payload", lambda *args: passes.append(1) or scored(*args))
    import_job(good, parcels, projects, root, "one", at)
    tables = read_together(spark, root, "one")
    assert {n: t.count() for n, t in tables.items()} == {"parcels": 2, "versions": 2, "evidence": 10, "anomalies": 3, "queue": 2} and passes == [1]
    # every table is a projection of the scored files
    assert {r.status for r in tables["parcels"].collect()} == {"ai_processed", "needs_review"}
    with pytest.raises(AlreadyCommitted):
        import_job(good, parcels, projects, root, "one", at)


def test_an_analysis_run_is_committed_once(spark, tmp_path, make_layer):
    layer = make_layer([(1, 1, [square(0, 0, 10)]), (1, 2, [square(5, 0, 10)])])
    parcels = spark.createDataFrame([(1, 1, 0.4), (2, 1, None)], "parcel_id long, project_id long, confidence double")
    history = spark.createDataFrame([(1, 1, "2024-01-01", 90.0), (2, 1, "2024-02-01", 45.0)], "version_id long, parcel_id long, at string, area_sqm double")
    history = history.select("version_id", "parcel_id", F.col("at").cast("timestamp").alias("captured_at"), "area_sqm")
    shapes = history.where("version_id = 2").join(layer.select(F.col("id").alias("parcel_id"), "rings"), "parcel_id").select("version_id", "parcel_id", "captured_at", "rings")
    root = str(tmp_path / "runs")
    analysis_job(parcels, layer, history, shapes, root, "run-1")
    tables = read_together(spark, root, "run-1")
    assert {n: t.count() for n, t in tables.items()} == {"analysis": 2, "health": 2, "anomalies": tables["anomalies"].count(), "queue": 2}
    assert {r.type for r in tables["anomalies"].collect()} == {"boundary_shift", "topology_break", "encroachment"}
    with pytest.raises(AlreadyCommitted):
        analysis_job(parcels, layer, history, shapes, root, "run-1")
