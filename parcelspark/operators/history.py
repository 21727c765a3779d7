"""Boundary history: latest versions, volatility, change rows, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centroid, distance, polygon_area
from ..functions.once import computed_once
from ..functions.scoring import (
    area_difference, area_difference_percent, area_ratio, boundary_ratio, discrepancy, severity,
)
from .overlay import intersection_area, symmetric_difference_area, union_area
from .skew import chunked_lag, latest_by, salted_lookup

VERSION_ORDER = ["captured_at", "version_id"]


def with_previous_area(versions: DataFrame, area: str = "area_sqm") -> DataFrame:
    """Each version with ``prev_<area>`` of the version before it."""
    return chunked_lag(versions, ["parcel_id"], VERSION_ORDER, None, [area])


def latest_version(versions: DataFrame, keep: list[str]) -> DataFrame:
    return latest_by(versions, ["parcel_id"], VERSION_ORDER, keep)


def historical_volatility(versions: DataFrame, area: str = "area_sqm") -> DataFrame:
    """``parcel_id, volatility``: mean relative area change between versions, each capped at 1."""
    steps = with_previous_area(versions, area)
    prev = F.col(f"prev_{area}")
    change = F.least(F.lit(1.0), F.abs(F.col(area) - prev) / F.nullif(prev, F.lit(0.0)))
    return steps.groupBy("parcel_id").agg(
        F.coalesce(F.avg(F.when(prev.isNotNull(), change)), F.lit(0.0)).alias("volatility"))


def version_changes(versions: DataFrame, area: str = "area_sqm") -> DataFrame:
    """One row per pair of consecutive versions: ratio, capped discrepancy, severity, text."""
    steps = chunked_lag(versions, ["parcel_id"], VERSION_ORDER, None, [area, "captured_at"])
    prev = F.col(f"prev_{area}")
    ratio = area_ratio(F.col(area), prev)
    capped = F.least(F.lit(1.0), ratio)
    level = severity(capped)
    return steps.where(prev.isNotNull()).select(
        "parcel_id", "version_id", "captured_at", "source",
        F.round(capped, 4).alias("normalized_discrepancy"),
        F.round(ratio, 4).alias("area_change_ratio"),
        level.alias("severity"),
        F.concat(
            F.initcap(level), F.lit(" historical change: parcel area changed by "),
            F.format_string("%.2f%%", ratio * 100), F.lit(" between "),
            F.date_format("prev_captured_at", "yyyy-MM-dd"), F.lit(" and "),
            F.date_format("captured_at", "yyyy-MM-dd"), F.lit("."),
        ).alias("explanation"),
    )


def discrepancy_of(pairs: DataFrame, keys: list[str], current: str, historical: str) -> DataFrame:
    """``keys`` with area ratio, boundary ratio, centroid shift and normalised discrepancy."""
    sized = computed_once(
        pairs, current_area=polygon_area(current), historical_area=polygon_area(historical),
        shift=distance(centroid(current), centroid(historical)))
    carry = ["current_area", "historical_area", "shift"]
    both = intersection_area(sized, keys, current, historical, carry=carry)
    cur, old, inter = F.col("current_area"), F.col("historical_area"), F.col("inter_area")
    a = area_ratio(cur, old)
    b = boundary_ratio(symmetric_difference_area(cur, old, inter), union_area(cur, old, inter))
    score = discrepancy(a, b)
    return both.select(
        *keys,
        F.round(score, 4).alias("normalized_discrepancy"),
        F.round(a, 4).alias("area_difference_ratio"),
        F.round(b, 4).alias("boundary_difference_ratio"),
        F.round("shift", 3).alias("centroid_shift_m"),
        severity(score).alias("severity"),
        F.concat(
            F.initcap(severity(score)), F.lit(" discrepancy detected: area difference="),
            F.format_string("%.2f%%", a * 100), F.lit(", boundary difference="),
            F.format_string("%.2f%%", b * 100), F.lit(", centroid shift="),
            F.format_string("%.2f", "shift"), F.lit(" processing units."),
        ).alias("explanation"),
    )


def latest_discrepancy(layer: DataFrame, versions: DataFrame) -> DataFrame:
    """Discrepancy of every parcel (``id, rings``) against its latest archived boundary."""
    latest = latest_version(versions, ["version_id", F.col("rings").alias("old_rings")])
    pairs = layer.join(latest, layer["id"] == latest["parcel_id"]).select("id", "rings", "old_rings")
    return discrepancy_of(pairs, ["id"], "rings", "old_rings")


def latest_different_version(layer: DataFrame, versions: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Latest archived boundary that differs from the current one, with areas and differences.

    Parcels without such a version keep one row of nulls.
    """
    archived = versions.select("version_id", "parcel_id", "captured_at", F.col("rings").alias("old_rings"))
    current = layer.select(F.col("id").alias("parcel_id"), "rings")
    pairs = computed_once(
        salted_lookup(archived, current, ["parcel_id"], "inner", spread=["version_id"]),
        current_area=polygon_area("rings"), historical_area=polygon_area("old_rings"))
    measured = intersection_area(
        pairs, ["version_id"], "rings", "old_rings",
        carry=["parcel_id", "captured_at", "current_area", "historical_area"])
    differing = measured.withColumn(
        "boundary_difference",
        symmetric_difference_area(F.col("current_area"), F.col("historical_area"), F.col("inter_area")),
    ).where(F.col("boundary_difference") > eps)
    latest = latest_by(
        differing, ["parcel_id"], VERSION_ORDER,
        ["version_id", "captured_at", "historical_area", "boundary_difference"])
    cur, old = F.col("current_area"), F.col("historical_area")
    return (
        layer.select(F.col("id").alias("parcel_id"), polygon_area("rings").alias("current_area"))
        .join(latest, "parcel_id", "left")
        .select(
            "parcel_id", "version_id", "captured_at", "current_area", "historical_area", "boundary_difference",
            area_difference(cur, old).alias("area_difference"),
            area_difference_percent(cur, old).alias("area_difference_percent"),
        )
    )


def history_rows(versions: DataFrame, columns: list[str]) -> DataFrame:
    """All versions, newest first inside each parcel (a range-partitioned total order)."""
    return versions.select("parcel_id", *columns).orderBy(
        "parcel_id", F.desc("captured_at"), F.desc("version_id"))
