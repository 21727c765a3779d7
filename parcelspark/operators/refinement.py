"""Report of a refinement run: the layer before and after it, what each parcel gained, and the gates on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import topology_counts


def rollout_totals(rollouts: DataFrame) -> DataFrame:
    """Per parcel: means over its rollouts and the spread of their rewards."""
    return rollouts.groupBy("parcel_id").agg(
        F.avg("displacement").alias("displacement"), F.avg("alignment_before").alias("alignment_before"),
        F.avg("alignment").alias("alignment_after"), F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"))


def refinement_report(before: DataFrame, after: DataFrame, parcel_reports: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope: counts, invalid shapes and overlap pairs before and after, movement, alignment, reward, gates.

    ``before``, ``after``: scope, id, rings. ``parcel_reports``: scope and, per parcel, displacement, alignment_before,
    alignment_after, reward_mean, reward_std. A parcel is changed when it moved at all. The topology gate asks for no
    invalid shape and no more overlap pairs than before; the alignment gate for a mean alignment no lower than before.
    """
    means = parcel_reports.groupBy(*scope).agg(
        F.count_if(F.col("displacement") > 0).alias("changed_parcels"),
        *[F.avg(c).alias(n) for c, n in (
            ("displacement", "mean_displacement"), ("alignment_before", "alignment_before"), ("alignment_after", "alignment_after"),
            ("reward_mean", "reward_mean"), ("reward_std", "reward_std"))])

    def state(layer: DataFrame, when: str) -> DataFrame:
        found = topology_counts(layer, scope)
        return found.select(
            *scope, F.col("parcels").alias(f"parcel_count_{when}"), F.col("invalid_geometry").alias(f"invalid_{when}"),
            F.col("overlap").alias(f"overlap_pairs_{when}"))

    rows = state(before, "before").join(state(after, "after"), scope, "left").join(means, scope, "left").fillna(
        0, ["parcel_count_after", "invalid_after", "overlap_pairs_after", "changed_parcels"])
    return rows.withColumn(
        "topology_gate", (F.col("invalid_after") == 0) & (F.col("overlap_pairs_after") <= F.col("overlap_pairs_before"))
    ).withColumn("alignment_gate", F.coalesce(F.col("alignment_after") >= F.col("alignment_before"), F.lit(False)))
