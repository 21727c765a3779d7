"""Domain views over the supplied tables: one deterministic DataFrame per entity.

The supplied star-schema tables stand in for the parcel store; every view
scans only the columns it needs, so pruning and pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box_ring, ring
from ..functions.once import computed_once

PROJECT_SIZE = 60
PITCH = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the narrow key rows out by hash ahead of geometry work that costs far more than its scan."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def project_of(parcel_id: Column) -> Column:
    return F.floor(parcel_id / PROJECT_SIZE).cast("long")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = (
        F.when(F.col("c_mktsegment") == "BUILDING", "ai_processed")
        .when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), "needs_review")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "verified")
        .otherwise("rejected")
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("parcel_id"),
        project_of(k).alias("project_id"),
        F.when(k % 19 != 0, (F.col("c_acctbal") + 1000) / 11003).alias("confidence"),
        F.when(k % 23 != 0, (k * 37 % 101) / 100.0).alias("health"),
        status.alias("status"),
        F.element_at(F.array(F.lit("ai_extracted"), F.lit("existing_gis"), F.lit("field_verified")),
                     (k % 3 + 1).cast("int")).alias("source"),
        F.element_at(F.array(*[F.lit(v) for v in ("residential", "agricultural", "commercial", "forest", "water")],
                             F.lit(None).cast("string")), (k % 6 + 1).cast("int")).alias("land_use"),
        (1 + k % 3).cast("int").alias("version"),
    )


def _lattice(k: Column) -> tuple[Column, Column, Column, Column]:
    """Origin and size of a parcel's box on its project's 10 x 6 lattice, in metres."""
    slot = k % PROJECT_SIZE
    x0 = (slot % 10) * PITCH
    y0 = F.floor(slot / 10) * PITCH
    return x0.cast("double"), y0.cast("double"), (50 + (k * 7) % 23).cast("double"), (45 + (k * 11) % 19).cast("double")


def parcel_rings(k: Column) -> Column:
    """Box, with a notched corner for every 5th parcel and a hole for every 7th."""
    x, y, w, h = _lattice(k)
    plain = box_ring(x, y, x + w, y + h)
    notched = ring([
        (x, y), (x + w, y), (x + w, y + h - 15), (x + w - 20, y + h - 15),
        (x + w - 20, y + h), (x, y + h), (x, y),
    ])
    hole = ring([
        (x + 10, y + 10), (x + 10, y + 20), (x + 20, y + 20), (x + 20, y + 10), (x + 10, y + 10),
    ])
    outer = F.when(k % 5 == 0, notched).otherwise(plain)
    return F.when(k % 7 == 0, F.array(outer, hole)).otherwise(F.array(outer))


def parcel_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project_id, id, rings``: current parcel geometry in metres."""
    k = F.col("c_custkey")
    keys = spread(table(spark, sf_dir, "customer").select(project_of(k).alias("project_id"), k.alias("id")), "id")
    return computed_once(keys, rings=parcel_rings(F.col("id")))


def comb_rings(k: Column) -> Column:
    """The parcel's box as a comb: a base of 10 m and two to five teeth of equal width and spacing."""
    x, y, w, h = _lattice(k)
    n = (2 + k % 4).cast("int")
    u = w / (2 * n - 1)

    def tooth(i: Column) -> Column:  # from right to left
        left, right = x + 2 * i * u, x + (2 * i + 1) * u
        return ring([(right, y + 10), (right, y + h), (left, y + h), (left, y + 10)])

    teeth = F.flatten(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), tooth))
    return F.array(F.concat(ring([(x, y), (x + w, y)]), teeth, ring([(x, y)])))


def reference_rings(k: Column) -> Column:
    x, y, w, h = _lattice(k)
    x = x + ((k * 13) % 9 - 4)
    y = y + ((k * 17) % 9 - 4)
    return F.array(box_ring(x, y, x + w, y + h))


def reference_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project_id, id, rings``: the surveyed reference faces, shifted boxes."""
    k = F.col("c_custkey")
    keys = spread(table(spark, sf_dir, "customer").select(project_of(k).alias("project_id"), k.alias("id")), "id")
    return computed_once(keys, rings=reference_rings(F.col("id")))


def lonlat_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parcel layer placed on longitude/latitude, one project per 0.02 degree row."""
    from ..functions.geometry import map_points, point

    layer = parcel_layer(spark, sf_dir)
    south = (F.col("project_id") % 100) * 0.02
    return computed_once(
        layer, rings=map_points("rings", lambda x, y: point(85.3 + x * 1e-5, 23.3 + south + y * 1e-5)))


def version_rings(key: Column, parcel: Column) -> Column:
    """Archived boundary: the parcel's box moved and resized by the version number."""
    x, y, w, h = _lattice(parcel)
    x = x + ((key * 13) % 9 - 4)
    y = y + ((key * 17) % 9 - 4)
    return F.array(box_ring(x, y, x + w + key % 5 - 2, y + h + key % 3 - 1))


def parcel_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``version_id, parcel_id, captured_at, source, area_sqm``: recorded boundary history."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("parcel_id"),
        F.col("o_orderdate").cast("timestamp").alias("captured_at"),
        F.when(F.col("o_orderkey") % 2 == 0, "ai_extracted").otherwise("field_verified").alias("source"),
        (F.col("o_totalprice") / 100).alias("area_sqm"),
    )


def version_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``version_id, parcel_id, captured_at, rings``: archived boundaries in metres.

    Every 4th version is an exact copy of the current boundary.
    """
    key, parcel = F.col("version_id"), F.col("parcel_id")
    keys = spread(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("parcel_id"),
        F.col("o_orderdate").cast("timestamp").alias("captured_at"),
    ), "version_id")
    return computed_once(
        keys, rings=F.when(key % 4 == 0, parcel_rings(parcel)).otherwise(version_rings(key, parcel)))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(v) for pair in {
        "1": "reject_building", "2": "reject_road", "3": "boundary_adjust", "4": "reject", "5": "reject_canal",
    }.items() for v in pair])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("correction_id"),
        F.col("o_custkey").alias("parcel_id"),
        kind[F.substring("o_orderpriority", 1, 1)].alias("correction_type"),
        F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderdate").cast("timestamp")).alias("created_at"),
    )


def survey_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("queue_id"),
        F.col("o_custkey").alias("parcel_id"),
        (F.col("o_totalprice") / 500000).alias("priority_score"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "pending").otherwise("assigned").alias("status"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 120).alias("assigned_to"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


COMPONENTS = ["segmentation", "topology", "edge_alignment", "deviation_from_baseline", "rl_refinement"]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parcel_id, component, score, seq...``; ids above the parcel range are orphans."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("parcel_id"),
        F.element_at(F.array(*[F.lit(c) for c in COMPONENTS]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("component"),
        F.round(F.col("l_discount") * 10, 6).alias("score"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.col("l_orderkey").alias("batch"),
        F.col("l_linenumber").alias("line"),
    )


ANOMALY_TYPES = {
    "error": "topology_break", "click": "boundary_shift", "view": "overlap",
    "purchase": "encroachment", "signup": "false_positive_road",
}


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``anomaly_id, parcel_id, type, magnitude, detected_at, props``."""
    kind = F.create_map(*[F.lit(v) for pair in ANOMALY_TYPES.items() for v in pair])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("anomaly_id"),
        F.col("user_id").alias("parcel_id"),
        F.coalesce(kind[F.col("event_type")], F.lit("overlap")).alias("type"),
        F.col("value").alias("magnitude"),
        F.col("ts").cast("timestamp").alias("detected_at"),
        "props",
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("project_id")
    return (
        table(spark, sf_dir, "customer").select(project_of(F.col("c_custkey")).alias("project_id")).distinct()
        .select(
            p,
            F.concat(F.when(p % 5 == 0, F.lit("DEMO_")).otherwise(F.lit("project_")), p.cast("string")).alias("name"),
            F.when(p % 3 == 0, "review").when(p % 3 == 1, "created").otherwise("completed").alias("status"),
            F.date_add(F.lit("2024-01-01"), (p * 37 % 365).cast("int")).cast("timestamp").alias("created_at"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))


RASTER_ROWS = 64


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raster_id, row, col, value``: boundary probability; -1 marks nodata.

    64 consecutive vectors of 64 numbers make one raster.
    """
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.posexplode("embedding").alias("col", "v"))
    row, col = (F.col("vec_id") % RASTER_ROWS), F.col("col").cast("long")
    probability = F.least(F.lit(1.0), F.abs(F.col("v").cast("double")) * 4)
    return v.select(
        F.floor(F.col("vec_id") / RASTER_ROWS).cast("long").alias("raster_id"),
        row.alias("row"), col.alias("col"),
        F.when((row * col) % 29 == 28, F.lit(-1.0)).otherwise(probability).alias("value"),
    )


def pixel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raster_id, row, col, value, label (0/1/255), hard (0..4)``."""
    r, c = F.col("row"), F.col("col")
    truth = F.when(F.col("value") < 0, 255).when((r * 31 + c * 17) % 11 == 0, 1).otherwise(0)
    hard = F.element_at(F.array(*[F.lit(v) for v in (0, 1, 2, 3, 4, 0, 0)]), ((r + c) % 7 + 1).cast("int"))
    return pixels(spark, sf_dir).select("raster_id", "row", "col", "value", truth.alias("label"), hard.alias("hard"))


def image_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raster_id, row, col, red, green, blue`` on the pixel grid, 0..255."""
    v = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.posexplode("embedding").alias("col", "v"))
    grey = F.floor(F.abs(F.col("v").cast("double")) * 2000) % 256
    col = F.col("col").cast("long")
    return v.select(
        F.floor(F.col("vec_id") / RASTER_ROWS).cast("long").alias("raster_id"),
        (F.col("vec_id") % RASTER_ROWS).alias("row"), col.alias("col"),
        grey.cast("double").alias("red"), ((grey * 3 + col) % 256).cast("double").alias("green"),
        ((grey * 5 + F.col("vec_id")) % 256).cast("double").alias("blue"),
    )


def raster_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raster_id, a,b,c,d,e,f, crs, height, width``: half-metre north-up grids."""
    r = F.col("raster_id")
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.floor(F.col("vec_id") / RASTER_ROWS).cast("long").alias("raster_id"), (F.col("vec_id") % RASTER_ROWS).alias("row"))
        .groupBy("raster_id").agg(F.max("row").alias("last"))
        .select(
            "raster_id", F.lit(2.0).alias("a"), F.lit(0.0).alias("b"), (1000.0 + r * 200).alias("c"),
            F.lit(0.0).alias("d"), F.lit(-2.0).alias("e"), F.lit(5000.0).alias("f"),
            F.lit("EPSG:32645").alias("crs"), (F.col("last") + 1).cast("int").alias("height"), F.lit(64).alias("width"),
        )
    )
