"""Keep a costly expression in one place of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections and filters refer to instead of repeating.

    Adjacent projections are merged by substituting expressions; a one-element
    ``inline`` is a node they cannot be merged through, so a long geometry
    expression is planned and evaluated once per row.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [n for n in df.columns if n not in columns]
    return df.select(*kept, F.inline(F.array(packed)))
