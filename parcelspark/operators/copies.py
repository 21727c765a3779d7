"""Exact copies of one geometry, worked on once and mapped back.

A pile of identical polygons would give every pair of the pile; grouping the
copies first keeps pair work linear in distinct shapes and loses no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bbox, polygon_area
from ..functions.identity import shape_keys
from ..functions.once import computed_once

SHAPE = ["_k1", "_k2"]


def with_shape_keys(layer: DataFrame, rings: str = "rings") -> DataFrame:
    first, second = shape_keys(F.col(rings))
    return computed_once(layer, _k1=first, _k2=second)


def distinct_shapes(layer: DataFrame, scope: list[str], rings: str = "rings", id_col: str = "id") -> DataFrame:
    """One row per distinct geometry of a scope: least id, number of copies, area and box."""
    shapes = (
        with_shape_keys(layer, rings)
        .groupBy(*scope, *SHAPE)
        .agg(
            F.min(id_col).alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first(rings).alias("rings"),
        )
    )
    sized = computed_once(shapes, area=polygon_area("rings"), _b=bbox("rings"))
    return sized.select(*scope, *SHAPE, "id", "copies", "rings", "area", "_b.*")
