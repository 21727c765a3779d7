"""Choosing rollouts, trials, thresholds, windows, splits and sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rollout_score
from .skew import chunked_rank, earliest_by, latest_by, salted_lookup, value_chunk

# Share of draws per patch role and the feedback share.
ROLE_MASS = {"positive_boundary": 0.55, "hard_negative": 0.30, "ordinary": 0.15}
FEEDBACK_FRACTION = 0.30


def best_rollout(rollouts: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Best-scoring rollout per parcel; the earliest one wins a tie."""
    scored = rollouts.withColumn(
        "score", rollout_score(*[F.col(n) for n in ("alignment", "overlap", "displacement", "jagged")]))
    return (
        scored.withColumn("_earlier", -F.col("rollout"))
        .transform(lambda d: latest_by(d, keys, ["score", "_earlier"], ["rollout", "score", *keep]))
    )


def trial_summary(records: DataFrame) -> DataFrame:
    """Per configuration: mean and worst harmonic IoU, objective, and whether every window has a candidate."""
    agg = records.groupBy("config_id").agg(
        F.avg("harmonic_mean_best_iou").alias("mean_harmonic_iou"),
        F.min("harmonic_mean_best_iou").alias("worst_harmonic_iou"),
        F.bool_and(F.col("candidate_count") >= 1).alias("viable"),
    )
    return agg.withColumn("objective", 0.8 * F.col("mean_harmonic_iou") + 0.2 * F.col("worst_harmonic_iou"))


def best_trial(summary: DataFrame) -> DataFrame:
    """The viable configuration with the highest objective, the first one on a tie."""
    return summary.where("viable").orderBy(F.desc("objective"), "config_id").limit(1)


def distinct_configurations(configs: DataFrame, columns: list[str]) -> DataFrame:
    """Each configuration once, keeping its earliest position."""
    return earliest_by(configs, columns, ["config_id"], ["config_id"])


def near_best_threshold(metrics: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Among thresholds within ``tolerance`` of the best IoU: highest precision, lowest FPR, highest threshold.

    ``metrics`` is one row per swept threshold, so the global window is over a
    handful of rows.
    """
    best = F.max("boundary_iou").over(Window.partitionBy())
    near = metrics.withColumn("_best", best).where(F.col("boundary_iou") >= F.col("_best") - tolerance)
    return near.drop("_best").orderBy(
        F.desc("precision"), "false_positive_rate", F.desc("threshold")).limit(1)


def stratified_windows(windows: DataFrame, order: list[str], k: int) -> DataFrame:
    """``k`` windows at evenly spaced ranks of a sorted list, with their pick number.

    ``rank`` comes from a range-partitioned sort: each partition counts its
    rows, the counts (one per partition) give the offsets.
    """
    ranked, n = global_rank(windows, order)
    if n < k:
        raise ValueError(f"{n} windows cannot give {k}")
    picks = list(dict.fromkeys(round(i * (n - 1) / max(k - 1, 1)) for i in range(k)))
    if len(picks) != k:
        raise ValueError("evenly spaced picks repeat a window")
    spark = windows.sparkSession
    wanted = spark.createDataFrame([(p, i) for i, p in enumerate(picks)], "rank long, pick int")
    return ranked.join(F.broadcast(wanted), "rank")


def global_rank(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """0-based rank over a total order without gathering rows, and the row count."""
    from ..session import cut_lineage

    # the checkpoint fixes which rows each partition holds before they are counted
    placed = cut_lineage(
        df.repartitionByRange(*[o if isinstance(o, Column) else F.col(o) for o in order])
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    spark = df.sparkSession
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    inside = Window.partitionBy("_part").orderBy(*order)
    ranked = placed.join(F.broadcast(starts), "_part").withColumn(
        "rank", F.col("_start") + F.row_number().over(inside) - 1)
    return ranked.drop("_part", "_start"), total


def split_schedule(train: int, validation: int, test: int) -> list[tuple[str, str]]:
    """Split and name of each pick: cycle train, validation, train, test while quotas last."""
    left = {"train": train, "validation": validation, "test": test}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[str, str]] = []
    while sum(left.values()):
        for split in ("train", "validation", "train", "test"):
            if left[split]:
                left[split] -= 1
                label = "train_selected" if split == "train" else split
                plan.append((split, f"{label}_{used[split]}"))
                used[split] += 1
    return plan


def assign_splits(picked: DataFrame, train: int, validation: int, test: int) -> DataFrame:
    """Give each pick its split and window name."""
    schedule = split_schedule(train, validation, test)
    rows = [(i, split, name) for i, (split, name) in enumerate(schedule)]
    plan = picked.sparkSession.createDataFrame(rows, "pick int, split string, name string")
    return picked.join(F.broadcast(plan), "pick")


def location_cells(features: DataFrame, scope: list[str], cell: float = 384.0) -> DataFrame:
    """Add the cell of each centroid (``cx, cy``) and ``group_index``, cells numbered by first row.

    ``seq`` is the feature order. The numbering runs over one row per cell, in
    chunks of the first row's position.
    """
    key = features.withColumn("cell_x", F.floor(F.col("cx") / cell)).withColumn("cell_y", F.floor(F.col("cy") / cell))
    cells = key.groupBy(*scope, "cell_x", "cell_y").agg(F.min("seq").alias("_first"))
    numbered = chunked_rank(
        cells, scope, ["_first"], value_chunk(F.col("_first").cast("double")), "group_index").drop("_first")
    return salted_lookup(key, numbered, [*scope, "cell_x", "cell_y"], "inner", spread=["seq"])


def sampling_group_weights(groups: DataFrame, feedback_fraction: float = FEEDBACK_FRACTION) -> DataFrame:
    """``source_group, role, patches, weight``: per-patch weight of each (source, role) group.

    Missing roles and sources hand their share to those present; weights have
    mean 1 over all patches. The work is one aggregate to at most six groups.
    """
    if not 0 <= feedback_fraction <= 1:
        raise ValueError("feedback_fraction must be between zero and one")
    source_mass = F.when(F.col("source_group") == "feedback", feedback_fraction).otherwise(1 - feedback_fraction)
    role_mass = F.create_map(*[F.lit(v) for pair in ROLE_MASS.items() for v in pair])[F.col("role")]
    by_source = Window.partitionBy("source_group")
    everything = Window.partitionBy()
    counted = groups.groupBy("source_group", "role").agg(F.count(F.lit(1)).alias("patches"))
    shares = (
        counted.withColumn("_source", source_mass)
        .withColumn("_roles", F.count(F.lit(1)).over(by_source))
        .withColumn("_present", F.sum(F.col("_source") / F.col("_roles")).over(everything))
        .withColumn("_role", role_mass / F.sum(role_mass).over(by_source))
        .withColumn("_total", F.sum("patches").over(everything))
    )
    # the masses add up to one, so the scale to mean 1 is the number of patches
    return shares.select(
        "source_group", "role", "patches",
        (F.col("_source") / F.col("_present") * F.col("_role") / F.col("patches") * F.col("_total")).alias("weight"))


def invalid_sampling_groups(groups: DataFrame) -> DataFrame:
    return groups.where(
        ~F.col("source_group").isin("reference", "feedback") | ~F.col("role").isin(*ROLE_MASS)
    ).select("source_group", "role").distinct()


def class_weight(positive: Column, negative: Column) -> Column:
    """Positive-class weight: negatives over positives, kept within 1.5 and 4."""
    return F.greatest(F.lit(1.5), F.least(F.lit(4.0), negative / F.greatest(positive, F.lit(1))))
