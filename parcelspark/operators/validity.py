"""Polygon validity inside the row: structure as column expressions, self-crossing by an Arrow kernel; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area, ring_signed_area
from ..functions.once import computed_once
from .pair_kernels import self_crossing


def structural_reason(rings: Column | str) -> Column:
    """First broken structural rule, or null."""
    r = F.col(rings) if isinstance(rings, str) else rings
    open_ended = F.exists(r, lambda g: (g[0]["x"] != F.element_at(g, -1)["x"]) | (g[0]["y"] != F.element_at(g, -1)["y"]))
    return (
        F.when(r.isNull() | (F.size(r) == 0), "empty")
        .when(F.exists(r, lambda g: F.size(g) < 4), "too_few_positions")
        .when(open_ended, "not_closed")
        .when(F.exists(r, lambda g: F.size(F.array_distinct(g)) < 3), "too_few_distinct_points")
        .when(F.exists(r, lambda g: ring_signed_area(g) == 0), "zero_area")
        .when(polygon_area(r) <= 0, "holes_exceed_exterior")
    )


def invalid_reason(rings: Column | str) -> Column:
    """Why the polygon is not valid, or null."""
    return F.coalesce(structural_reason(rings), F.when(self_crossing(rings), "self_intersection"))


def with_validity(layer: DataFrame, rings: str = "rings") -> DataFrame:
    """Add ``invalid_reason`` (null when valid) and ``is_valid``."""
    return computed_once(layer, invalid_reason=invalid_reason(rings)).withColumn(
        "is_valid", F.col("invalid_reason").isNull())
