"""Remove boilerplate lines: lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# fixed pattern: the six ASCII spaces around a line do not count
EDGE_SPACES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
MIN_SITES = 10
SKETCH_BITS = 10  # 2**10 registers: a standard error of 1.04 / 32
STANDARD_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def document_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, text_key, site, pos, line, key of every line that is not blank."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"),
                    F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "raw"))
        .select("doc_id", "text_key", "site", "pos", F.regexp_replace("raw", EDGE_SPACES, "").alias("line"))
        .where("line <> ''").withColumn("key", F.xxhash64("line"))
    )


def widespread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key, line (null: every line of the key) and the first place (doc_id, pos) of lines found in ``min_sites`` sites or more.

    Each line hash gets a HyperLogLog sketch of its sites; sketches are built
    per task and merged by the aggregation, so a line that is everywhere costs
    one small row per task. Estimates further from the threshold than four
    standard errors (and one site) decide at once; the others get an exact
    count of distinct sites, by the line itself.
    """
    margin = max(1.0, 4 * STANDARD_ERROR * min_sites)
    sketched = stored(
        lines.groupBy("key").agg(
            F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"))
        .select("key", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites - margin),
        "spread-lines")
    near = sketched.where(F.col("sites") <= min_sites + margin).select("key")
    exact = (
        lines.join(near, "key", "left_semi").where(F.col("site").isNotNull())
        .groupBy("key", "line", "site").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
        .groupBy("key", "line").agg(F.count(F.lit(1)).alias("sites"), F.min("first").alias("first"))
        .where(F.col("sites") >= min_sites)
    )
    sure = sketched.where(F.col("sites") > min_sites + margin)
    return sure.select("key", F.lit(None).cast("string").alias("line"), "first").unionByName(exact.select("key", "line", "first"))


def removed_places(docs: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, text_key and the sorted line numbers to remove, for rows that lose any."""
    lines = document_lines(docs, id_col, text_col, site_col)
    spread = stored(widespread_lines(lines, min_sites), "boilerplate").withColumnsRenamed({"line": "own_line"})
    return (
        lines.join(spread, "key").where(F.col("own_line").isNull() | (F.col("own_line") == F.col("line")))
        .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    )


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the column ``_removed`` (how many lines went).

    A line (without outer white space, blank ones never) found in ``min_sites``
    or more distinct sites goes everywhere but at its first place, the smallest
    (doc_id, position), so its text is not lost. Every row stays.

    Null texts stay null; empty texts stay empty; a null site counts as no site; rows with
    a null id can lose lines too; repeated rows are treated alike; other columns stay as they are.
    """
    places = removed_places(docs, min_sites, id_col, text_col, site_col).withColumnsRenamed(
        {"doc_id": "_place_id", "text_key": "_place_key", "removed": "_places"})
    keyed = docs.withColumn("_text_key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    met = keyed.join(places, F.col(id_col).cast("long").eqNullSafe(F.col("_place_id")) & (F.col("_text_key") == F.col("_place_key")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_places"))
    text = F.when(F.col("_places").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_split"), i)), "\n"))
    return met.withColumn("_split", F.when(F.col("_places").isNotNull(), lines)).select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("_removed"))
