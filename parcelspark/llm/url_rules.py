"""Allow and block rules on urls as a sort-merge range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

BLANK_SALTS = 4096  # parts over which pages without a host are spread


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after ``://``, lower-cased) and path; both empty for null or a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def canonical_key(host: Column, path: Column) -> Column:
    """Labels from the top level down, then the path; a host holds no slash, so the first slash ends it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("/"), path)


def nested_rules(rules: DataFrame) -> DataFrame:
    """One row per rule key with its stack: itself and every rule whose interval encloses its own."""
    base = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(
            canonical_key(F.col("host"), F.col("path")).alias("key"),
            F.concat("host", "path").alias("rule"), "verdict",
        )
    )
    # an enclosing rule is a prefix of the key, so all prefixes are looked up by equality
    prefixes = base.select(
        F.col("key").alias("inner_key"),
        F.explode(F.transform(
            F.sequence(F.length(F.substring_index("key", "/", 1)) + 1, F.length("key")),
            lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"),
    )
    return (
        prefixes.join(base, "key")
        .groupBy(F.col("inner_key").alias("key"))
        .agg(F.array_sort(F.collect_list(F.struct("key", "rule", "verdict"))).alias("stack"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
    partitions: int | None = None,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict; a rule fits its host and all
    subdomains when the url's path starts with its path. The longest rule
    (characters of host and path, then the later in order) wins; without a
    fitting rule the verdict is ``default``.

    Distinct (host, path) pairs are looked up under each suffix of their host.
    Reversed host labels and path make one key, so that a rule is the interval
    of keys that start with its own. Rules and keys are range partitioned and
    sorted together; the sweep carries the stack of the last rule passed, which
    holds every interval still open at a key. A rule open across a partition
    border is carried over by one small row per partition, so a key shared by very
    many hosts (their home pages under one suffix) may be cut anywhere.

    Null urls and urls without ``://`` have an empty host and path: only a rule with
    an empty host and path fits them, so they are spread over the join and never looked up. Repeated
    pages are judged each; contradicting rules with the same host and path
    count as the alphabetically last verdict (block); rules with a null field are ignored;
    empty tables are fine; other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    blank = (F.col("host") == "") & (F.col("path") == "")
    wanted = judged.where(~blank).select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = wanted.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    stacks = nested_rules(rules)
    empty = F.lit(None).cast(stacks.schema["stack"].dataType)
    line = stacks.select("key", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), "stack").unionByName(
        suffixes.select(canonical_key(F.col("suffix"), F.col("path")).alias("key"), F.lit(1).alias("kind"),
                        "host", "path", empty.alias("stack")))
    # stored, because range borders come from a sample and must be the same wherever the parts are read
    dealt = stored(
        line.repartitionByRange(partitions, "key", "kind", "host", "path").withColumn("part", F.spark_partition_id()), "url-keys")
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so the window without keys is bounded by their number
    ends = (
        dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("last"))
        .select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    )
    open_rules = dealt.select("*", F.last("stack", ignorenulls=True).over(sweep).alias("here")).join(F.broadcast(ends), "part")
    fitting = F.filter(F.coalesce("here", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    best = (
        open_rules.where("kind = 1").select("host", "path", F.try_element_at(fitting, F.lit(-1)).alias("r"))
        .where(F.col("r").isNotNull())
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("r.rule"), F.col("r.rule"), F.col("r.verdict"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))
    )
    of_blank = rules.where((F.col("host") == "") & (F.col("path") == "")).agg(F.max("verdict")).first()[0]  # one value
    apart = F.concat(F.lit("/"), F.pmod(F.xxhash64("page_id"), F.lit(BLANK_SALTS)).cast("string"))  # no host holds a slash
    joined = judged.withColumn("_host", F.when(blank, apart).otherwise(F.col("host"))).join(
        best.withColumnRenamed("host", "_host"), ["_host", "path"], "left")
    return joined.select(
        "page_id", "host", "path", F.when(blank, F.lit(None if of_blank is None else "")).otherwise(F.col("rule")).alias("rule"),
        F.coalesce(F.when(blank, F.lit(of_blank)).otherwise(F.col("rule_verdict")), F.lit(default)).alias("verdict"))
