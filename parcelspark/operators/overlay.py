"""Overlay areas of polygon pairs.

The intersection area is a sum over edge pairs: every non-vertical edge is the
lower border of a signed trapezoid, and two trapezoids share the area under
the lower of their two lines. Both polygons stand in the pair's row, so the sum
is taken there (``pair_kernels``): no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once
from .pair_kernels import shared_area


def intersection_area(
    pairs: DataFrame, keys: list[str], a: str, b: str, carry: list[str] | None = None, out: str = "inter_area"
) -> DataFrame:
    """``keys, carry, out`` with the exact overlap area of ring columns ``a`` and ``b``.

    One row per row of ``pairs``; ``carry`` columns are kept. Pairs that only
    touch, or lack a geometry, get 0.
    """
    kept = [*keys, *(carry or [])]
    return computed_once(pairs.select(*kept, a, b), **{out: shared_area(a, b)}).select(*kept, out)


def union_area(a: Column, b: Column, inter: Column) -> Column:
    return a + b - inter


def symmetric_difference_area(a: Column, b: Column, inter: Column) -> Column:
    return F.greatest(a + b - 2.0 * inter, F.lit(0.0))


def iou(a: Column, b: Column, inter: Column) -> Column:
    union = union_area(a, b, inter)
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def overlaps(a: Column, b: Column, inter: Column, eps: float = 1e-6) -> Column:
    """Interiors meet and neither polygon covers the other."""
    return (inter > eps) & (inter < F.least(a, b) - eps)


def equal_shapes(a: Column, b: Column, inter: Column, eps: float = 1e-6) -> Column:
    return symmetric_difference_area(a, b, inter) <= eps
