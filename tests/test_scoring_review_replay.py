from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import RINGS, square, to_rings
from parcelspark.functions import identity as I
from parcelspark.functions import scoring as S
from parcelspark.operators import contracts as K
from parcelspark.operators import replay as X
from parcelspark.operators import reports as R
from parcelspark.operators import review as V
from parcelspark.operators import selection as L
from parcelspark.operators.skew import chunked_lag, chunked_rank, chunked_running_max, ordered_chunks, exact_quantiles, rows_listed, rows_not_listed, salted_lookup, value_chunk


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("args,score,band", [
    ((0.7, False, 0.1, 0.2), 0.82, "medium"), ((1.0, False, 0.0, 0.0), 1.0, "high"), ((0.2, True, 1.0, 1.0), 0.08, "low"),
])
def test_health_scores(spark, args, score, band):
    got = value(spark, S.health_score(*[F.lit(a) for a in args]))
    assert got == score and value(spark, S.health_band(F.lit(got))) == band


def test_priorities_and_reasons(spark):
    assert value(spark, S.priority_score(*[F.lit(a) for a in (0.7, 0.1, 0.2, 1, False)])) == 0.2083
    assert value(spark, S.priority_score(*[F.lit(a) for a in (0.3, 0.7, 0.6, 2, True)])) > 0.5
    assert value(spark, S.priority_score(*[F.lit(a) for a in (0.95, 0.02, 0.01, 0, False)])) < 0.1
    assert value(spark, S.priority_reason(*[F.lit(a) for a in (0.9, 0.0, 0.0, 0, False)])) == "low-risk parcel; routine review"
    assert value(spark, S.priority_reason(*[F.lit(a) for a in (0.5, 0.3, 0.5, 4, True)])) == (
        "low confidence, historical/record discrepancy, historical instability, 4 anomaly(s), topology violation")


def test_bands_null_and_limits(spark):
    df = spark.createDataFrame([(None,), (0.85,), (0.6,), (0.599,)], "c double")
    assert [r.b for r in df.select(S.confidence_band(F.col("c")).alias("b")).collect()] == [None, "HIGH", "MEDIUM", "LOW"]


def test_gates(spark):
    base = (0.10, 0.18, 0.30, 0.02)
    fields = "boundary_iou double, boundary_f1 double, precision double, false_positive_rate double"

    def gate(candidate):
        df = spark.createDataFrame([(candidate, base)], f"c struct<{fields.replace(' double', ':double')}>, b struct<{fields.replace(' double', ':double')}>")
        return df.select(S.validation_gate(F.col("c"), F.col("b")).alias("g")).first().g

    assert gate((0.11, 0.19, 0.30, 0.02))
    assert not gate((0.11, 0.19, 0.29, 0.02)) and not gate((0.11, 0.19, 0.30, 0.021)) and not gate((0.10, 0.19, 0.30, 0.02))
    # a missing target delta never promotes
    assert value(spark, S.final_promotion_eligible(F.lit(True), F.lit(0.1), F.lit(-0.1), F.lit(None).cast("double"))) is False


def test_uuid_matches_the_standard_library(spark):
    import uuid

    for name in ("a", "v2:3:{}", "äöü"):
        assert value(spark, I.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    u = uuid.uuid5(uuid.NAMESPACE_URL, "x")
    for text in (str(u).upper(), u.hex, f"{{{u}}}", f"urn:uuid:{u}"):
        assert value(spark, I.canonical_uuid(F.lit(text))) == str(u)
    assert value(spark, I.canonical_uuid(F.lit("nope"))) is None


def test_review_outcomes_and_summary(spark):
    t = datetime(2024, 1, 2)
    parcels = spark.createDataFrame(
        [(1, 0, "verified"), (2, 0, "rejected"), (3, 0, "needs_review"), (4, 0, "rejected")], "parcel_id long, project_id long, status string")
    corrections = spark.createDataFrame(
        [(1, 1, "reject_road", None), (2, 1, "boundary_adjust", t), (3, 2, "reject_road", t), (4, 4, "reject", t)],
        "correction_id long, parcel_id long, correction_type string, created_at timestamp")
    out = V.review_outcomes(parcels, corrections)
    roles = {r.parcel_id: (r.training_role, r.false_positive_class) for r in out.collect()}
    assert roles == {1: ("positive_boundary", None), 2: ("hard_negative", "road"), 3: (None, None), 4: (None, None)}
    s = V.export_summary(out, ["project_id"]).first()
    assert (s.eligible_reviewed_labels, s.positive_boundaries, s.hard_negatives, s.rejected_without_specific_label) == (2, 1, 1, 1)
    assert s.false_positive_classes == {"road": 1} and not s.training_ready


def test_dashboard_uses_status_not_confidence(spark):
    parcels = spark.createDataFrame(
        [("needs_review", 0.99, None), ("verified", 0.0, None), ("ai_processed", None, None)], "status string, confidence double, health double")
    queue = spark.createDataFrame([("a", "pending"), ("a", "assigned"), ("b", "completed")], "parcel_id string, status string")
    row = R.dashboard(parcels, queue).first()
    assert (row.total, row.verified, row.needs_review, row.field_pending) == (3, 1, 1, 1)
    assert row.average_confidence == pytest.approx(0.495) and row.average_health is None
    assert R.dashboard(parcels.limit(0), queue.limit(0)).first().average_confidence is None


def day(n):
    return datetime(2024, 1, n)


def test_replay_of_patches_and_decisions(spark):
    old, new, newer = (to_rings(square(0, 0, s)) for s in (10, 20, 30))
    parcels = spark.createDataFrame(
        [(1, 0, old, "ai_extracted", "needs_review", 0.9, 0.8, "forest", 1), (2, 0, old, "existing_gis", "needs_review", 0.7, 0.6, None, 1),
         (3, 0, old, "ai_extracted", "needs_review", 0.5, 0.5, None, 2)],
        f"parcel_id long, project_id long, rings {RINGS}, source string, status string, confidence double, health double, land_use string, version int")
    events = spark.createDataFrame([
        (1, 1, day(1), "patch", None, None, new, "orchard", None),
        (2, 1, day(2), "verify", "boundary_adjust", None, newer, None, None),
        (3, 1, day(3), "verify", "reject", "false_positive_road", None, None, None),
        (4, 2, day(1), "verify", "reject", "false_positive_canal", None, None, None),
        (5, 2, day(2), "verify", "split", None, None, None, None),
        (6, 2, day(2), "verify", "boundary_adjust", "false_positive_road", None, None, None),
    ], f"event_id long, parcel_id long, at timestamp, kind string, correction_type string, review_label string, rings {RINGS}, land_use string, status string")
    evidence = spark.createDataFrame(
        [(1, "topology", 0.5, "goes"), (2, "topology", 0.4, "keep me")], "parcel_id long, component string, score double, explanation string")
    queue = spark.createDataFrame([(1, 1, "pending", day(1)), (2, 1, "assigned", day(9)), (3, 3, "pending", day(1))],
                                  "queue_id long, parcel_id long, status string, created_at timestamp")
    out = X.replay(events, parcels, evidence, queue)
    rows = {r.parcel_id: r for r in out.parcels.collect()}
    a, b, c = rows[1], rows[2], rows[3]
    assert (a.status, a.source, a.version, a.confidence, a.area_sqm, a.land_use) == ("rejected", "field_verified", 4, None, 900, "orchard")
    assert (b.status, b.source, b.version, b.confidence) == ("rejected", "existing_gis", 2, 0.7)
    assert (c.status, c.version, c.confidence, c.area_sqm) == ("needs_review", 2, 0.5, 100)
    archived = {r.version_id: (r.source, r.rings[0][1].x) for r in out.versions.collect()}
    assert archived == {1: ("ai_extracted", 10), 2: ("ai_extracted", 20)}
    assert {(r.parcel_id, r.component) for r in out.evidence.collect()} == {
        (1, "review_label"), (2, "topology"), (2, "review_label")}
    assert {r.queue_id: r.status for r in out.queue.collect()} == {1: "completed", 2: "assigned", 3: "pending"}
    assert {r.event_id for r in out.refused.collect()} == {5, 6}
    assert {r.correction_id: r.correction_type for r in out.corrections.collect()} == {
        2: "boundary_adjust", 3: "reject_road", 4: "reject_canal"}
    assert {r.explanation for r in out.evidence.where("component = 'topology'").collect()} == {"keep me"}
    widths = {r.correction_id: (r.original_rings[0][1].x, r.corrected_rings[0][1].x) for r in out.corrections.collect()}
    assert widths == {2: (20, 30), 3: (30, 30), 4: (10, 10)}
    lonlat = {r.parcel_id: r.area_sqm for r in X.replay(events, parcels, evidence, queue, geodesic=True).parcels.collect()}
    assert lonlat[3] > 1e11  # ten by ten degrees, not a hundred square metres


def test_explanations_hold_every_text(spark):
    parcels = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (3, None, None), (4, 0.5, None)], "parcel_id long, confidence double, health double")
    evidence = spark.createDataFrame([
        (1, "review_label", 0.0, day(1), 0, 1, "first"), (1, "review_label", 0.0, day(2), 0, 1, "second"),
        (2, "topology", 0.1, day(1), 0, 1, "x"), (2, "topology", 0.1, day(2), 0, 1, "Boundary agreed"), (4, "topology", 0.1, day(1), 0, 1, None),
    ], "parcel_id long, component string, score double, created_at timestamp, batch long, line long, text string")
    got = {r.parcel_id: r.explanation for r in R.explanation(parcels, evidence).collect()}
    assert got[1] == "Overall confidence 0.50. first second" and got[2] == "Boundary agreed"
    assert got[3] == R.NO_EVIDENCE_TEXT and got[4].startswith("Overall confidence 0.50.")


def test_sampling_weights(spark):
    def weights(groups, **kw):
        df = spark.createDataFrame(groups, "source_group string, role string")
        return {(r.source_group, r.role): (r.patches, r.weight) for r in L.sampling_group_weights(df, **kw).collect()}

    w = weights([("reference", "positive_boundary")] * 6 + [("reference", "ordinary")] * 2 + [("feedback", "hard_negative")] * 2)
    total = sum(n * x for n, x in w.values())
    assert total == pytest.approx(10)
    assert w[("feedback", "hard_negative")][1] * 2 / total == pytest.approx(0.30)
    assert w[("reference", "positive_boundary")][1] * 6 / total == pytest.approx(0.7 * 0.55 / 0.70)
    bad = spark.createDataFrame([("other", "ordinary")], "source_group string, role string")
    assert L.invalid_sampling_groups(bad).count() == 1
    with pytest.raises(ValueError):
        L.sampling_group_weights(bad, 1.5)


def test_hot_keys_and_chunks_give_the_plain_answer(spark):
    rows = [(1 if i % 3 else i, i, float((i * 7919) % 101), datetime(2024, 1 + i % 12, 1 + i % 28)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long, v double, at timestamp")
    dim = df.select("k").distinct().withColumn("d", F.col("k") * 2)
    plain = sorted(map(tuple, df.join(dim, "k").select("k", "id", "d").collect()))
    assert sorted(map(tuple, salted_lookup(df, dim, ["k"], "inner", rows_per_salt=5).select("k", "id", "d").collect())) == plain
    lagged = {r.id: r.prev_v for r in chunked_lag(df, ["k"], ["at", "id"], F.date_trunc("month", "at"), ["v"]).collect()}
    want, last = {}, {}
    for k, i, v, at in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        want[i] = last.get(k)
        last[k] = v
    assert lagged == want
    some = df.where("k = 1").select("k")
    assert {r.id for r in rows_listed(df, some, ["k"]).collect()} == {r[1] for r in rows if r[0] == 1}
    assert {r.id for r in rows_not_listed(df, some, ["k"]).collect()} == {r[1] for r in rows if r[0] != 1}
    ranks = {r.id: r.n for r in chunked_rank(df, ["k"], ["v", "id"], value_chunk(F.col("v")), "n").collect()}
    groups = {}
    for k, i, v, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(k, []).append(i)
    assert ranks == {i: n for ids in groups.values() for n, i in enumerate(ids)}
    got = exact_quantiles(df.where("k = 1"), [], "v", {"m": 0.5, "p": 0.99}).first()
    ordered = sorted(r[2] for r in rows if r[0] == 1)

    def q(p):
        at = p * (len(ordered) - 1)
        lo = int(at)
        return ordered[lo] + (ordered[min(lo + 1, len(ordered) - 1)] - ordered[lo]) * (at - lo)

    assert got.m == pytest.approx(q(0.5)) and got.p == pytest.approx(q(0.99))


def test_companion_and_payload_rules(spark):
    a, b = to_rings(square(0, 0, 1)), to_rings(square(0, 0, 1.000001))
    left = spark.createDataFrame([("x", a), ("y", a), ("w", a)], f"id string, rings {RINGS}")
    right = spark.createDataFrame([("x", a), ("y", b), ("z", a)], f"id string, rings {RINGS}")
    assert {(r.kind, r.id) for r in K.companion_report(left, right).collect()} == {
        ("missing_metadata", "w"), ("missing_geometry", "z"), ("geometry_mismatch", "y")}


def test_split_schedule():
    plan = L.split_schedule(9, 3, 3)
    assert [s for s, _ in plan[:8]] == ["train", "validation", "train", "test"] * 2
    assert sum(s == "train" for s, _ in plan) == 9 and plan[0][1] == "train_selected_0" and plan[-1] == ("train", "train_selected_8")


def test_a_hot_key_on_one_day_is_cut_by_counts(spark, monkeypatch):
    from parcelspark.operators import skew

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    monkeypatch.setattr(skew.ordered_chunks, "__defaults__", (200,))
    try:
        # key 1 holds a third of the rows, all with one time; key null is large too
        rows = [(1, "2024-05-01", i) for i in range(3000)] + [(None, "2024-05-01", 50_000 + i) for i in range(900)]
        rows += [(2 + i % 700, f"2024-0{1 + i % 9}-01", 10_000 + i) for i in range(5100)]
        df = spark.createDataFrame(rows, "k long, at string, id long").withColumn("v", F.col("id") * 7 % 1000).repartition(6)
        sizes = [r["count"] for r in ordered_chunks(df, ["k"], ["at", "id"]).groupBy("k", "_chunk").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) <= 400
        lagged = chunked_lag(df, ["k"], ["at", "id"], None, ["v"]).collect()
        seen = {r.id: r.m for r in chunked_running_max(df, ["k"], ["at", "id"], None, "v", "m").collect()}
        ranks = {r.id: r.n for r in chunked_rank(df, ["k"], ["at", "id"], None, "n").collect()}
        want_lag, want_max, want_rank, last, most, n = {}, {}, {}, {}, {}, {}
        for k, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
            v = i * 7 % 1000
            want_lag[i], want_rank[i] = last.get(k), n.get(k, 0)
            last[k], n[k], most[k] = v, n.get(k, 0) + 1, max(v, most.get(k, 0))
            want_max[i] = most[k]
        assert {r.id: r.prev_v for r in lagged} == want_lag and seen == want_max and ranks == want_rank
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
