"""Points along boundaries and distances between boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import exterior, ring_edges
from .pair_kernels import mean_boundary_distance, polygon_gap


def measured_edges(r: Column | str) -> Column:
    """Ring edges with their start and end along the ring: struct<x1,y1,x2,y2,from,to>."""
    r = F.col(r) if isinstance(r, str) else r
    edges = F.filter(ring_edges(r), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    lengths = F.transform(edges, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    ends = F.aggregate(
        lengths,
        F.array(F.lit(0.0)),
        lambda acc, d: F.array_append(acc, F.element_at(acc, -1) + d),
    )
    return F.transform(
        F.arrays_zip(edges.alias("e"), F.slice(ends, 1, F.size(edges)).alias("f"), F.slice(ends, 2, F.size(edges)).alias("t")),
        lambda z: F.struct(
            z["e"]["x1"].alias("x1"), z["e"]["y1"].alias("y1"), z["e"]["x2"].alias("x2"), z["e"]["y2"].alias("y2"),
            z["f"].alias("from"), z["t"].alias("to"),
        ),
    )


def boundary_samples(layer: DataFrame, keep: list[str], rings: str, count: Column | int) -> DataFrame:
    """``keep, sample, sx, sy``: ``count`` points at fractions 0, 1/count, ... of the exterior.

    Every edge emits the sample indices that fall on it, so the work is linear
    in samples and no point searches for its edge.
    """
    n = F.lit(count) if isinstance(count, int) else count
    edges = layer.select(
        *keep, n.cast("long").alias("_n"), measured_edges(exterior(rings)).alias("_e")
    ).withColumn("_total", F.element_at("_e", -1)["to"])
    step = F.col("_total") / F.col("_n")
    on_edge = edges.select(*keep, "_n", step.alias("_step"), F.explode("_e").alias("_e"))
    first = F.ceil(F.col("_e.from") / F.col("_step"))
    last = F.least(F.ceil(F.col("_e.to") / F.col("_step")) - 1, F.col("_n") - 1)
    points = on_edge.where(first <= last).select(
        *keep, "_step", "_e", F.explode(F.sequence(first, last)).alias("sample")
    )
    along = (F.col("sample") * F.col("_step") - F.col("_e.from")) / (F.col("_e.to") - F.col("_e.from"))
    return points.select(
        *keep, "sample",
        (F.col("_e.x1") + along * (F.col("_e.x2") - F.col("_e.x1"))).alias("sx"),
        (F.col("_e.y1") + along * (F.col("_e.y2") - F.col("_e.y1"))).alias("sy"),
    )


def symmetric_boundary_distance(pairs: DataFrame, keys: list[str], a: str, b: str, count: int = 96) -> DataFrame:
    """``keys, boundary_distance``: mean of the two directed mean distances, each over ``count`` exterior samples.

    Both polygons stand in the pair's row, so everything is measured there. Null where a geometry is missing.
    """
    return pairs.select(*keys, mean_boundary_distance(count)(a, b).alias("boundary_distance"))


def polygon_distance(pairs: DataFrame, keys: list[str], a: str, b: str, carry: list[str] | None = None) -> DataFrame:
    """``keys, carry, distance``: 0 when the polygons share area, else the least edge distance, measured in the row."""
    return pairs.select(*keys, *(carry or []), polygon_gap(a, b).alias("distance"))
