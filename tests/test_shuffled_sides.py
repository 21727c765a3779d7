"""Sides of geometry joins that grow with the input are shuffled, however small the planner takes them to be."""

import pytest

from parcelspark.functions import geometry as G
from parcelspark.operators import grid
from parcelspark.operators import topology as T
from parcelspark.operators.compare import best_iou
from parcelspark.operators.readiness import split_leakage
from parcelspark.session import cut_lineage
from parcelspark.sources import domain as D

SCOPE = ["project_id"]


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("narrow"))
    spark.range(240).selectExpr("id AS c_custkey").write.parquet(f"{folder}/customer.parquet")
    return D.parcel_layer(spark, folder), D.reference_layer(spark, folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def many(monkeypatch):
    monkeypatch.setattr(grid, "BROADCAST_OBJECTS", 100, raising=False)


def test_pairs_of_a_layer_are_not_broadcast(layers):
    boxed = G.with_bbox(layers[0])
    for df in (grid.self_candidates(boxed, SCOPE, ["rings"]), split_leakage(boxed.withColumn("split", boxed["id"] % 3), SCOPE),
               grid.cross_candidates(boxed, G.with_bbox(layers[1]), SCOPE, ["rings"], ["rings"])):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_values_go_back_to_parcels_by_a_shuffle(layers):
    for df in (best_iou(*layers, SCOPE), T.topology_violation(layers[0], SCOPE)):
        assert plan(df).count("SortMergeJoin") >= 2


def test_few_objects_are_broadcast_and_give_the_same_pairs(layers, monkeypatch):
    boxed = [G.with_bbox(layer) for layer in layers]
    got = []
    for limit in (0, 10_000):
        monkeypatch.setattr(grid, "BROADCAST_OBJECTS", limit)
        got.append(sorted((r.l_id, r.r_id) for r in grid.cross_candidates(*boxed, SCOPE, [], []).collect()))
    assert got[0] and got[0] == got[1]


def test_parcels_are_not_broadcast_to_meet_their_median(layers):
    text = plan(T.slivers(cut_lineage(layers[0]), SCOPE))
    assert "SortMergeJoin" in text and "BuildLeft" not in text
