"""Tables that appear together: data files first, then one manifest that names them all.

``root/_data/<attempt>/<table>`` holds what an attempt wrote; ``root/_commits/<version>`` holds the manifest of the
attempt that was committed. Readers go through the manifest only. An attempt that dies, before its manifest or while
it is written, leaves files that nobody is led to, and the version can be written again. Everything goes through
Spark's readers and writers, so the root can be in any store that Spark reaches. One writer per version at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, name string, path string, committed_at timestamp"


class AlreadyCommitted(RuntimeError):
    """The version exists; committed versions are never overwritten."""


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows below a folder; none where there is no folder, or no finished file in it."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


@dataclass(frozen=True)
class Attempt:
    """One run of a job: where it writes before it commits."""

    spark: SparkSession
    root: str
    version: str
    id: str

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a table of the attempt and go on from its files, so later tables that need it do not compute it again."""
        path = self.path(name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/_data/{self.id}/{name}"

    def commit(self, names: list[str]) -> None:
        """Make the named tables visible, all at once: the manifest is a single file that appears when it is whole."""
        refuse_committed(self.spark, self.root, self.version)
        rows = [(self.version, n, self.path(n)) for n in names]
        manifest = self.spark.createDataFrame(rows, "version string, name string, path string")
        # a folder without a finished manifest is what an attempt left that died while writing it
        manifest.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(_folder(self.root, self.version))


def _folder(root: str, version: str) -> str:
    return f"{root}/_commits/{version}"


def refuse_committed(spark: SparkSession, root: str, version: str) -> None:
    if not _manifests(spark, _folder(root, version)).isEmpty():
        raise AlreadyCommitted(f"version {version} of {root} is already committed")


def begin(spark: SparkSession, root: str, version: str) -> Attempt:
    """Start an attempt at a version; refused at once if the version is committed."""
    if not version or version != version.strip() or any(c in version for c in "/\\*?[]{}") or version.startswith((".", "_")):
        raise ValueError(f"not a version name: {version!r}")
    refuse_committed(spark, root, version)
    return Attempt(spark, root.rstrip("/"), version, uuid.uuid4().hex)


def write_together(root: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Write all tables under one version, then show them together."""
    attempt = begin(next(iter(tables.values())).sparkSession, root, version)
    for name, df in tables.items():
        attempt.write(name, df)
    attempt.commit(list(tables))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``version, committed_at, tables``: committed versions."""
    return _manifests(spark, f"{root}/_commits").groupBy("version").agg(
        F.max("committed_at").alias("committed_at"), F.count(F.lit(1)).alias("tables"))


def read_together(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    """The tables of a committed version."""
    listed = _manifests(spark, _folder(root.rstrip("/"), version)).collect()  # one row per table
    if not listed:
        raise LookupError(f"version {version} of {root} is not committed")
    return {r["name"]: spark.read.parquet(r["path"]) for r in listed}
