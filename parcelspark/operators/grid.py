"""Candidate pairs of a spatial join by grid cells, an equi-join Spark can shuffle.

Objects are filed at a level whose cell is at least as large as their box, so
an object touches at most four cells of its level. Two objects meet at the
coarser of their two levels; the pair is kept only in the cell that holds the
lower-left corner of the box intersection, so no ``distinct`` is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import shuffled

BOX = ["minx", "miny", "maxx", "maxy"]
# A cell with more filed objects than this is split over several tasks.
OBJECTS_PER_CELL = 10_000
# Largest salt table that is broadcast; above it the salts are shuffled.
BROADCAST_CELLS = 50_000
# Most filed objects, by their counted number, that are broadcast in a join of candidates.
BROADCAST_OBJECTS = 10_000


def _level(margin: float, floor_level: int) -> Column:
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) + 2 * margin
    exact = F.ceil(F.log2(F.greatest(side, F.lit(1e-12)))).cast("int")
    # one level up when rounding left the cell smaller than the box
    safe = F.when(F.pow(F.lit(2.0), exact) < side, exact + 1).otherwise(exact)
    return F.greatest(safe, F.lit(floor_level))


def _cells(level: Column, margin: float) -> Column:
    size = F.pow(F.lit(2.0), level)

    def axis(low: str, high: str) -> Column:
        return F.sequence(
            F.floor((F.col(low) - margin) / size).cast("long"),
            F.floor((F.col(high) + margin) / size).cast("long"),
        )

    return F.flatten(F.transform(
        axis("minx", "maxx"),
        lambda i: F.transform(
            axis("miny", "maxy"), lambda j: F.struct(i.alias("cx"), j.alias("cy"))),
    ))


@dataclass
class _Stats:
    levels: list[int]
    hot_cells: int
    filed: int


def _file(df: DataFrame, margin: float, floor_level: int) -> DataFrame:
    return df.withColumn("_own", _level(margin, floor_level))


def _stats(filed: DataFrame, scope: list[str], margin: float, objects_per_cell: int) -> _Stats:
    """Levels in use (at most the exponent range of a double), the number of crowded cells and of filed objects."""
    cells = filed.select(*scope, "_own", F.explode(_cells(F.col("_own"), margin)).alias("_c"))
    counts = cells.groupBy(*scope, "_own", "_c").count()
    rows = counts.groupBy("_own").agg(
        F.count_if(F.col("count") > objects_per_cell).alias("hot"), F.sum("count").alias("filed")).collect()
    return _Stats(sorted(r["_own"] for r in rows), sum(r["hot"] for r in rows), sum(r["filed"] for r in rows))


def _salted(build: DataFrame, probe: DataFrame, key: list[str], stats_hot: int,
            objects_per_cell: int, build_id: str = "r_id") -> tuple[DataFrame, DataFrame, list[str]]:
    """Deal the filed objects of crowded cells over salts and repeat the probes per salt."""
    if stats_hot == 0:
        return build, probe, key
    hot = (
        build.groupBy(*key).count().where(F.col("count") > objects_per_cell)
        .select(*key, F.ceil(F.col("count") / objects_per_cell).cast("int").alias("_salts"))
    )
    if stats_hot <= BROADCAST_CELLS:
        hot = F.broadcast(hot)
    dealt = build.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(build_id), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    ).drop("_salts")
    repeated = probe.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    return dealt, repeated, [*key, "_salt"]


def _side(df: DataFrame, tag: str, scope: list[str], carry: list[str]) -> DataFrame:
    """Only keys, box and the carried columns enter the shuffle."""
    return df.select(
        *scope, "_own", F.col("id").alias(f"{tag}_id"),
        *[F.col(b).alias(f"{tag}_{b}") for b in BOX],
        *[F.col(c).alias(f"{tag}_{c}") for c in carry],
        *BOX,
    )


def _filed_rows(df: DataFrame, margin: float) -> DataFrame:
    return df.withColumn("_lvl", F.col("_own")).withColumn(
        "_c", F.explode(_cells(F.col("_own"), margin))).drop(*BOX)


def _probe_rows(df: DataFrame, levels: list[int], margin: float, strictly: bool) -> DataFrame:
    """The object at every level in use that is at least (or above) its own."""
    used = F.array(*[F.lit(v) for v in levels])
    own = F.col("_own")
    wanted = F.filter(used, lambda v: (v > own) if strictly else (v >= own))
    return (
        df.withColumn("_lvl", F.explode(wanted))
        .withColumn("_c", F.explode(_cells(F.col("_lvl"), margin)))
        .drop(*BOX)
    )


def _meet(probe: DataFrame, build: DataFrame, key: list[str], filed: int) -> DataFrame:
    """Join of probes and filed objects. Only few objects by their count are broadcast.

    Pairs are costly to measure, so they stay dealt over all tasks however few bytes they are.
    """
    if filed <= BROADCAST_OBJECTS:
        return probe.join(F.broadcast(build), key)
    parts = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return probe.repartition(parts, *key).join(shuffled(build), key)


def _keep_once(pairs: DataFrame, margin: float) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("_lvl"))
    x = F.greatest("l_minx", "r_minx") - margin
    y = F.greatest("l_miny", "r_miny") - margin
    touching = (
        (F.col("l_minx") - margin <= F.col("r_maxx") + margin)
        & (F.col("r_minx") - margin <= F.col("l_maxx") + margin)
        & (F.col("l_miny") - margin <= F.col("r_maxy") + margin)
        & (F.col("r_miny") - margin <= F.col("l_maxy") + margin)
    )
    here = (F.floor(x / size) == F.col("_c.cx")) & (F.floor(y / size) == F.col("_c.cy"))
    return pairs.where(touching & here)


def self_candidates(
    layer: DataFrame,
    scope: list[str],
    carry: list[str],
    margin: float = 0.0,
    floor_level: int = -60,
    objects_per_cell: int = OBJECTS_PER_CELL,
) -> DataFrame:
    """Pairs ``l_id < r_id`` of one layer whose boxes, grown by ``margin``, meet.

    ``layer`` has ``id``, the box columns and the ``scope`` columns; ``carry``
    columns come out as ``l_*`` and ``r_*``.
    """
    filed = _file(layer, margin, floor_level)
    stats = _stats(filed, scope, margin, objects_per_cell)
    if not stats.levels:
        stats.levels = [floor_level]
    left = _probe_rows(_side(filed, "l", scope, carry), stats.levels, margin, strictly=False)
    right = _filed_rows(_side(filed, "r", scope, carry), margin).withColumnRenamed("_own", "_rown")
    left = left.withColumnRenamed("_own", "_lown")
    right, left, key = _salted(right, left, [*scope, "_lvl", "_c"], stats.hot_cells, objects_per_cell)
    pairs = _meet(left, right, key, stats.filed).where(
        (F.col("_lown") < F.col("_rown")) | (F.col("l_id") < F.col("r_id")))
    pairs = _keep_once(pairs.where(F.col("l_id") != F.col("r_id")), margin)
    swap = F.col("l_id") > F.col("r_id")
    names = ["id", *BOX, *carry]
    return pairs.select(
        *scope,
        *[F.when(swap, F.col(f"r_{n}")).otherwise(F.col(f"l_{n}")).alias(f"l_{n}") for n in names],
        *[F.when(swap, F.col(f"l_{n}")).otherwise(F.col(f"r_{n}")).alias(f"r_{n}") for n in names],
    )


def cross_candidates(
    left: DataFrame,
    right: DataFrame,
    scope: list[str],
    carry_left: list[str],
    carry_right: list[str],
    margin: float = 0.0,
    floor_level: int = -60,
    objects_per_cell: int = OBJECTS_PER_CELL,
) -> DataFrame:
    """Pairs of a left and a right object whose boxes, each grown by ``margin``, meet."""
    fl, fr = _file(left, margin, floor_level), _file(right, margin, floor_level)
    sl = _stats(fl, scope, margin, objects_per_cell)
    sr = _stats(fr, scope, margin, objects_per_cell)
    lside = _side(fl, "l", scope, carry_left)
    rside = _side(fr, "r", scope, carry_right)

    # left objects against right objects filed at the same or a coarser level
    probe = _probe_rows(lside, sr.levels or [floor_level], margin, strictly=False).drop("_own")
    build = _filed_rows(rside, margin).drop("_own")
    build, probe, key = _salted(build, probe, [*scope, "_lvl", "_c"], sr.hot_cells, objects_per_cell)
    pairs = _keep_once(_meet(probe, build, key, sr.filed), margin)
    names = [
        *scope, *[f"l_{n}" for n in ["id", *BOX, *carry_left]], *[f"r_{n}" for n in ["id", *BOX, *carry_right]],
    ]
    pairs = pairs.select(*names)
    if sl.levels and sr.levels and sr.levels[0] < sl.levels[-1]:
        # right objects against left objects filed at a coarser level
        probe = _probe_rows(rside, sl.levels, margin, strictly=True).drop("_own")
        build = _filed_rows(lside, margin).drop("_own")
        build, probe, key = _salted(build, probe, [*scope, "_lvl", "_c"], sl.hot_cells,
                                    objects_per_cell, build_id="l_id")
        pairs = pairs.unionByName(_keep_once(_meet(probe, build, key, sl.filed), margin).select(*names))
    return pairs
