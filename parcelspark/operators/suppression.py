"""Greedy choice of non-overlapping polygons, larger ones first, as rounds over a conflict graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .copies import SHAPE, distinct_shapes, with_shape_keys
from .skew import salted_lookup, shuffled
from .topology import COUNT_EPS, overlap_areas


def greedy_independent(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes the sequential greedy choice accepts.

    ``edges(better, worse)`` is acyclic: every edge points to the polygon that
    comes later in the greedy order. A round accepts each open node with no
    open better neighbour and rejects the neighbours of accepted nodes; the
    result equals the sequential order whatever the number of rounds.
    """
    open_edges = cut_lineage(edges.select("better", "worse").distinct())
    rejected: DataFrame | None = None
    while not open_edges.isEmpty():
        blocked = open_edges.select(F.col("worse").alias("better")).distinct().withColumn("_blocked", F.lit(True))
        seen = salted_lookup(open_edges, blocked, ["better"], "left", spread=["worse"], large=True)
        # a free better node is accepted now, so all its worse neighbours are out
        out = cut_lineage(
            seen.where(F.col("_blocked").isNull()).select(F.col("worse").alias("id")).distinct())
        rejected = out if rejected is None else rejected.unionByName(out)
        gone = out.withColumn("_gone", F.lit(True))
        left = salted_lookup(open_edges, gone.withColumnRenamed("id", "worse"), ["worse"], "left", spread=["better"], large=True)
        left = left.where(F.col("_gone").isNull()).drop("_gone")
        left = salted_lookup(left, gone.withColumnRenamed("id", "better"), ["better"], "left", spread=["worse"], large=True)
        left = left.where(F.col("_gone").isNull()).drop("_gone")
        # edges of accepted nodes lead only to rejected ones, so they are gone too
        open_edges = cut_lineage(left)
    if rejected is None:
        return nodes
    return nodes.join(shuffled(rejected), "id", "left_anti")


def suppress_overlaps(layer: DataFrame, scope: list[str], eps: float = COUNT_EPS) -> DataFrame:
    """``scope, id, area`` of accepted polygons: area descending, least id first among equals.

    Copies of one geometry conflict with each other, so only the least id of a
    pile can be accepted; the pile enters the graph as one node. Ids are unique
    over the layer.
    """
    shapes = cut_lineage(distinct_shapes(layer, scope))
    conflicts = overlap_areas(shapes, scope).where(F.col("inter_area") > eps)
    left_first = (F.col("l_area") > F.col("r_area")) | (
        (F.col("l_area") == F.col("r_area")) & (F.col("l_id") < F.col("r_id")))
    edges = conflicts.select(
        F.when(left_first, F.col("l_id")).otherwise(F.col("r_id")).alias("better"),
        F.when(left_first, F.col("r_id")).otherwise(F.col("l_id")).alias("worse"),
    )
    kept = greedy_independent(edges, shapes.select(*scope, *SHAPE, "id", "area", "copies"))
    tiny = kept.where((F.col("copies") > 1) & (F.col("area") <= eps))
    single = kept.where(~((F.col("copies") > 1) & (F.col("area") <= eps))).select(*scope, "id", "area")
    # copies too small to conflict are all accepted
    members = with_shape_keys(layer.select(*scope, "id", "rings")).select(*scope, *SHAPE, "id")
    extra = salted_lookup(
        members, tiny.select(*scope, *SHAPE, "area"), [*scope, *SHAPE], "inner", spread=["id"], large=True
    ).select(*scope, "id", "area")
    return single.unionByName(extra)
