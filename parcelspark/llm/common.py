"""Helpers shared by the training-text operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Kernels look at this many bytes of text at a time, so their arrays stay small whatever a batch holds.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so other columns can have any name."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and go on from the files: survives lost executors, cuts the lineage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_rows(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def runs_by_bytes(rows: list[bytes], limit: int = BLOCK_BYTES):
    """Consecutive [from, to) runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    start = size = 0
    for i, row in enumerate(rows):
        if i > start and size + len(row) > limit:
            yield start, i
            start, size = i, 0
        size += len(row)
    if start < len(rows):
        yield start, len(rows)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for odd bases."""
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread polynomial hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))
