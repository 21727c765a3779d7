"""Joins and orderings that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# A key with more rows than this is spread over several tasks.
ROWS_PER_SALT = 1_000_000
# A key with more rows than this is ordered in several chunks.
ROWS_PER_CHUNK = 1_000_000
# Rows without a key are spread over so many tasks.
NULL_SALTS = 4096


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, shuffled and never sent to the driver as a broadcast.

    The planner guesses sizes from the narrow key columns that geometry is computed from, a small part of the true size.
    """
    return side.hint("merge")


def salted_lookup(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    spread: list[str] | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    large: bool = False,
) -> DataFrame:
    """Many-to-one join of ``facts`` with ``dim`` (unique on ``on``).

    Keys with more than ``rows_per_salt`` fact rows get several salts: their
    facts are dealt out over the salts and their one dimension row is repeated
    once per salt. Only such keys are broadcast, and there can be at most
    ``rows(facts) / rows_per_salt`` of them, whatever the data looks like.
    ``spread`` names columns that tell fact rows of one key apart (default:
    all); the salt is a hash of them, so a retried task deals rows out alike.
    ``large`` tells that ``dim`` grows with the input: it is shuffled whatever
    size the planner guesses.
    """
    if how not in ("left", "inner"):
        raise ValueError("salted_lookup joins facts to a dimension: left or inner")
    hot = (
        facts.groupBy(*on)
        .count()
        .where((F.col("count") > rows_per_salt))
        .where(F.expr(" and ".join(f"`{k}` is not null" for k in on)))
        .select(*on, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts"))
    )
    hot = F.broadcast(hot)
    row_hash = F.pmod(F.xxhash64(*(spread or facts.columns)), F.col("_salts")).cast("int")
    # null keys match nothing, so they may be dealt out anywhere
    keyless = F.expr(" or ".join(f"`{k}` is null" for k in on))
    anywhere = F.pmod(F.xxhash64(*(spread or facts.columns)), F.lit(NULL_SALTS)).cast("int")
    salted = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.when(keyless, anywhere).when(F.col("_salts").isNull(), 0).otherwise(row_hash))
        .drop("_salts")
    )
    copies = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(shuffled(copies) if large else copies, [*on, "_salt"], how).drop("_salt")


def _flagged(facts: DataFrame, keys: DataFrame, on: list[str], spread: list[str] | None) -> DataFrame:
    listed = keys.select(*on).distinct().withColumn("_listed", F.lit(True))
    return salted_lookup(facts, listed, on, "left", spread)


def rows_listed(facts: DataFrame, keys: DataFrame, on: list[str], spread: list[str] | None = None) -> DataFrame:
    """Semi join that deals a hot key of ``facts`` over several tasks."""
    return _flagged(facts, keys, on, spread).where(F.col("_listed").isNotNull()).select(*facts.columns)


def rows_not_listed(facts: DataFrame, keys: DataFrame, on: list[str], spread: list[str] | None = None) -> DataFrame:
    """Anti join that deals a hot key of ``facts`` over several tasks."""
    return _flagged(facts, keys, on, spread).where(F.col("_listed").isNull()).select(*facts.columns)


def latest_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``: a partial aggregate, never a sorted group."""
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def earliest_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*keep), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``df`` with ``_chunk``, a number that does not decrease along ``order`` within a key.

    Keys are counted first. A key of up to ``rows_per_chunk`` rows is one chunk. The rows of larger keys are ranged by
    (key, order) over tasks and a chunk is what fell into one range, so it follows the number of rows and not the
    calendar: a key whose rows all have one date is cut as finely as any other.
    """
    counts = df.groupBy(*keys).count().where(F.col("count") > rows_per_chunk)
    # one row per large key: at most rows / rows_per_chunk of them
    large = cut_lineage(counts.select(*[F.col(k).alias(f"_large_{k}") for k in keys], "count"))
    rows = large.agg(F.sum("count")).first()[0]
    if not rows:
        return df.withColumn("_chunk", F.lit(0))
    same = _same(df, large, keys, "_large_")
    ranged = df.join(large, same, "left_semi").repartitionByRange(max(2, -(-2 * rows // rows_per_chunk)), *keys, *order)
    ranged = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id() + 1))
    return df.join(large, same, "left_anti").withColumn("_chunk", F.lit(0)).unionByName(ranged)


def _same(df: DataFrame, other: DataFrame, keys: list[str], prefix: str) -> Column:
    """Equal keys, null with null; those of ``other`` carry the prefix."""
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"{prefix}{k}"]) for k in keys])


def _chunks(df: DataFrame, keys: list[str], order: list, chunk: Column | None) -> DataFrame:
    return ordered_chunks(df, keys, order) if chunk is None else df.withColumn("_chunk", chunk)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what the chunks before theirs leave (``carry``: keys, _chunk and other columns)."""
    marks = [*keys, "_chunk"]
    named = carry.withColumnsRenamed({k: f"_of_{k}" for k in marks})
    return rows.join(named, _same(rows, named, marks, "_of_"), "left").drop(*[f"_of_{k}" for k in marks])


def chunked_lag(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column | None,
    values: list[str],
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(values)`` per key without sorting a whole key in one task.

    ``chunk`` must not decrease along ``order`` (a value bucket); without one,
    chunks are counted ranges (:func:`ordered_chunks`). Rows are ordered inside (key, chunk); only the last row of every
    chunk is carried to the next chunk of the same key, so a key with a third
    of all rows is worked on by as many tasks as it has chunks.
    """
    parts = _chunks(df, keys, order, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = F.struct(*values)
    rows = parts.withColumn("_lag", F.lag(packed).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    carry = (
        parts.groupBy(*keys, "_chunk")
        .agg(F.max_by(packed, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .select(*keys, "_chunk", "_carry")
    )
    joined = _with_carry(rows, carry, keys)
    lagged = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))
    return joined.withColumn("_lagged", lagged).select(
        *df.columns, *[F.col("_lagged")[v].alias(prefix + v) for v in values]
    )


def chunked_rank(df: DataFrame, keys: list[str], order: list, chunk: Column | None, out: str) -> DataFrame:
    """0-based rank per key; ``chunk`` must not decrease along ``order``.

    Rows are numbered inside (key, chunk) and shifted by the row counts of the
    chunks before, so no key is sorted in one task.
    """
    parts = _chunks(df, keys, order, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    )
    return (
        _with_carry(parts.withColumn("_rn", F.row_number().over(inside)), offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_rn") - 1).select(*df.columns, out)
    )


def chunked_running_max(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, value: str, out: str
) -> DataFrame:
    """Largest ``value`` up to and including each row, per key, with the same chunking as the lag."""
    parts = _chunks(df, keys, order, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        parts.groupBy(*keys, "_chunk").agg(F.max(value).alias("_m"))
        .withColumn("_carry", F.max("_m").over(earlier)).drop("_m")
    )
    return (
        _with_carry(parts.withColumn("_here", F.max(value).over(inside)), carry, keys)
        .withColumn(out, F.greatest("_here", "_carry")).select(*df.columns, out)
    )


def value_chunk(v: Column, per_octave: int = 4096) -> Column:
    """Order-preserving bucket of a double: finer than 0.02 % of the value, both signs."""
    magnitude = F.floor(F.log2(F.abs(v)) * per_octave) + 1100 * per_octave
    return (
        F.when(v > 0, magnitude).when(v < 0, -magnitude).otherwise(F.lit(0)).cast("long")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], per_octave: int = 4096
) -> DataFrame:
    """Exact interpolated quantiles per key group, one row per group.

    Equal values are counted first; running counts are taken over value
    buckets (a bounded number per group); only the buckets that hold a wanted
    rank are ordered row by row. No group is ever gathered in one place.
    """
    marker = "_all"
    group = keys or [marker]
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    if not keys:
        base = base.withColumn(marker, F.lit(0))
    counted = (
        base.groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", value_chunk(F.col("_v"), per_octave))
    )
    buckets = (
        counted.groupBy(*group, "_bucket")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(
            Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_before", F.coalesce("_before", F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*group)))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("pos"))
        for name, q in quantiles.items()
    ])
    # rank positions are 0-based; the lower and upper neighbour may sit in different buckets
    targets = (
        buckets.withColumn("_w", F.explode(wanted))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(
            F.floor(F.col("_w.pos")), F.ceil(F.col("_w.pos"))))))
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bn")))
        .select(*group, "_bucket", "_before", F.col("_w.name").alias("_name"),
                F.col("_w.pos").alias("_pos"), "_rank")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy("_v")
    wanted_buckets = targets.select(*group, "_bucket").distinct()
    ranked = (
        counted.join(wanted_buckets, [*group, "_bucket"], "left_semi")
        .withColumn("_upto", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    hits = (
        ranked.join(targets, [*group, "_bucket"])
        .where((F.col("_rank") - F.col("_before") < F.col("_upto"))
               & (F.col("_rank") - F.col("_before") >= F.col("_upto") - F.col("_n")))
    )
    fraction = F.col("_pos") - F.floor(F.col("_pos"))
    per_quantile = hits.groupBy(*group, "_name").agg(
        F.min_by("_v", "_rank").alias("_lo"), F.max_by("_v", "_rank").alias("_hi"),
        F.max(fraction).alias("_frac"),
    ).withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    result = per_quantile.groupBy(*group).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in quantiles
    ])
    return result if keys else result.drop(marker)
