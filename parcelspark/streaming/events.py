"""Review events and anomalies as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replay import Replay, replay
from ..operators.skew import rows_listed, rows_not_listed, salted_lookup

EVENT_SCHEMA = (
    "event_id bigint, parcel_id bigint, at timestamp, kind string, correction_type string, review_label string, "
    "rings array<array<struct<x:double,y:double>>>, land_use string, status string, queue_id bigint, assigned_to bigint")


def read_events(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """Event files as a stream; repeated event ids within the delay are dropped."""
    return (
        spark.readStream.schema(EVENT_SCHEMA).parquet(path)
        .withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])
    )


def _earlier(spark: SparkSession, root: str, table: str, batch: int) -> DataFrame | None:
    """Rows that batches before this one wrote, or None before the first."""
    return spark.read.parquet(f"{root}/{table}").where(F.col("batch") < batch) if batch else None


def replay_stream(
    events: DataFrame, checkpoint: str, root: str, base: Callable[[], Replay],
    users: Callable[[], DataFrame] | None = None, geodesic: bool = False,
) -> StreamingQuery:
    """Apply review and assignment events whenever they arrive: the result is that of all events in their own order.

    A batch adds its new events (an id seen in any earlier batch is dropped) to the
    log ``root/events`` and replays the whole log of the parcels it touches from the
    ``base`` tables, so a late event takes its place in the order. Only rows of touched
    parcels are written, under the batch's own folder; :func:`current` reads the newest
    ones. A batch that runs again overwrites its own folders from the same input.
    """
    spark = events.sparkSession

    def apply(batch_events: DataFrame, batch: int) -> None:
        log = _earlier(spark, root, "events", batch)
        fresh = batch_events.dropDuplicates(["event_id"])
        if log is not None:
            fresh = fresh.join(log.select("event_id"), "event_id", "left_anti")
        # written first: the log entry is what the rest of the batch reads
        fresh.select(*batch_events.columns).write.mode("overwrite").parquet(f"{root}/events/batch={batch}")
        fresh = spark.read.schema(EVENT_SCHEMA).parquet(f"{root}/events/batch={batch}")
        start = base()
        known = fresh if log is None else log.drop("batch").unionByName(fresh)
        of = start.queue.select("queue_id", F.col("parcel_id").alias("_of"))
        placed = salted_lookup(known, of, ["queue_id"], "left", spread=["event_id"]).withColumn("_of", F.coalesce("parcel_id", "_of"))
        new = salted_lookup(fresh, of, ["queue_id"], "left", spread=["event_id"])
        new.select(F.coalesce("parcel_id", "_of").alias("parcel_id")).where("parcel_id IS NOT NULL").distinct().write.mode(
            "overwrite").parquet(f"{root}/touched/batch={batch}")
        touched = spark.read.schema("parcel_id bigint").parquet(f"{root}/touched/batch={batch}")
        mine = rows_listed(placed, touched.withColumnRenamed("parcel_id", "_of"), ["_of"], spread=["event_id"]).drop("_of")
        lost = new.where(F.col("parcel_id").isNull() & F.col("_of").isNull()).drop("_of")
        after = replay(
            mine.unionByName(lost), *[rows_listed(getattr(start, t), touched, ["parcel_id"]) for t in ("parcels", "evidence", "queue")],
            geodesic=geodesic, users=users() if users else None)
        for t in ("parcels", "evidence", "queue", "versions", "corrections", "anomalies", "refused"):
            getattr(after, t).write.mode("overwrite").parquet(f"{root}/{t}/batch={batch}")

    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, root: str, table: str, base: DataFrame | None = None) -> DataFrame:
    """The table after all batches: of each parcel the rows of the last batch that touched it, else its ``base`` rows."""
    last = spark.read.parquet(f"{root}/touched").groupBy("parcel_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{root}/{table}")
    newest = rows_listed(rows, last, ["parcel_id", "batch"]).drop("batch")
    if base is None:
        return newest
    return rows_not_listed(base, last, ["parcel_id"]).unionByName(newest, allowMissingColumns=True).select(*newest.columns)


def daily_anomaly_counts(anomalies: DataFrame, projects_of: DataFrame | None = None, delay: str = "1 day",
                         width: str = "1 day") -> DataFrame:
    """Anomalies per window, type and project; the parcel lookup is a stream-static join."""
    rows = anomalies.withWatermark("detected_at", delay)
    keys = [F.window("detected_at", width).alias("window"), "type"]
    if projects_of is not None:
        rows = rows.join(projects_of.select("parcel_id", "project_id"), "parcel_id", "left")
        keys.append("project_id")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), *[k for k in keys[1:]], "events")
