"""Nearest polygon of another layer, by rounds of growing search radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_bbox
from ..session import cut_lineage
from .boundary import polygon_distance
from .grid import cross_candidates, self_candidates
from .skew import shuffled


def _box_gap(left: str = "l", right: str = "r"):
    """Least possible distance of two polygons, from their boxes."""
    dx = F.greatest(
        F.col(f"{left}_minx") - F.col(f"{right}_maxx"), F.col(f"{right}_minx") - F.col(f"{left}_maxx"), F.lit(0.0))
    dy = F.greatest(
        F.col(f"{left}_miny") - F.col(f"{right}_maxy"), F.col(f"{right}_miny") - F.col(f"{left}_maxy"), F.lit(0.0))
    return F.hypot(dx, dy)


def nearest_polygon(source: DataFrame, target: DataFrame, scope: list[str],
                    radius: float, growth: float = 4.0) -> DataFrame:
    """``scope, source_id, target_id, distance``: closest target of each source (ties: least id).

    A round looks for targets within the radius. A source is settled when its
    best distance is within that radius, as nothing outside can be closer. The
    others go on with a larger radius. Targets without a usable geometry (null,
    empty or not finite) are no targets; sources of a scope that has none are
    left out, and so are sources without a usable geometry. Every other source has a
    target at a finite distance, so the loop ends when all are settled, at the
    latest when the radius spans every box.
    """
    boxed_target = _usable(target.select(*scope, "id", "rings"))
    scopes = boxed_target.select(*scope).distinct()
    pending = _usable(source.select(*scope, "id", "rings"))
    if scope:
        pending = pending.join(scopes, scope, "left_semi")
    elif boxed_target.isEmpty():
        return _empty(source, scope)
    corners = boxed_target.select("minx", "miny", "maxx", "maxy").unionByName(pending.select("minx", "miny", "maxx", "maxy")).agg(
        F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    widest = 0.0 if corners[0] is None else 2 * (corners[2] - corners[0] + corners[3] - corners[1])
    settled: DataFrame | None = None
    while True:
        near = cross_candidates(pending, boxed_target, scope, ["rings"], ["rings"], margin=radius / 2)
        near = near.where(_box_gap() <= radius)
        keys = [*scope, "l_id", "r_id"]
        measured = polygon_distance(near, keys, "l_rings", "r_rings")
        best = (
            measured.groupBy(*scope, F.col("l_id").alias("source_id"))
            .agg(F.min(F.struct("distance", F.col("r_id").alias("target_id"))).alias("_b"))
            .select(*scope, "source_id", "_b.target_id", "_b.distance")
            .where(F.col("distance") <= radius)
        )
        best = cut_lineage(best)
        settled = best if settled is None else settled.unionByName(best)
        done = best.select(*scope, F.col("source_id").alias("id"))
        pending = cut_lineage(pending.join(shuffled(done), [*scope, "id"], "left_anti"))
        if radius > widest or pending.isEmpty():
            return settled
        radius *= growth


def _usable(layer: DataFrame) -> DataFrame:
    """Rows with an exterior and a box whose corners are finite numbers, with that box."""
    boxed = with_bbox(layer.where(F.coalesce(F.size(F.get("rings", F.lit(0))), F.lit(0)) > 0))
    finite = F.lit(True)
    for c in ("minx", "miny", "maxx", "maxy"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return boxed.where(finite)


def _empty(source: DataFrame, scope: list[str]) -> DataFrame:
    return source.select(
        *scope, F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit(0.0).alias("distance")
    ).limit(0)


def neighbours_within(layer: DataFrame, scope: list[str], reach: float) -> DataFrame:
    """``scope, l_id, r_id, distance``: pairs closer than ``reach`` (each pair once)."""
    boxed = with_bbox(layer.select(*scope, "id", "rings"))
    pairs = self_candidates(boxed, scope, ["rings"], margin=reach / 2).where(_box_gap() < reach)
    measured = polygon_distance(pairs, [*scope, "l_id", "r_id"], "l_rings", "r_rings")
    return measured.where(F.col("distance") < reach)
