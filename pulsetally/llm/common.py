"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pulsetally.session import shared_dir


def stash(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` below spark.checkpoint.dir and read it back: cuts lineage.

    A lost executor then costs its running tasks only. The folder stays until the
    job's owner clears the checkpoint folder, as the result is read lazily.
    """
    spark = frame.sparkSession
    path = shared_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def given_fields(frame: DataFrame, keep: list[str] | None, without: set[str]) -> list[str]:
    """The columns to keep, all by default, less those whose names the result needs."""
    return [c for c in (frame.columns if keep is None else keep) if c not in without]


#: Rows that a Python task holds at once, so that memory follows single texts, not batches.
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``SLICE`` rows; parts share the batch's memory.

    A worker takes one task after the other, so what the last one left is given back first.
    """
    release_memory()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def hash64(data: bytes) -> int:
    """A 64-bit hash that does not depend on the process (xxhash64)."""
    return xxh64_intdigest(data)


def release_memory() -> None:
    """Give this process's free memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer known."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two of at least ``n``, within bounds."""
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(1.0, n))))))


#: Bits of a table for each entry, and its greatest size: 16 MB.
TABLE_BITS, TABLE_MOST = 256, 1 << 27


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits set at the values of the column ``hash``: a filter of bounded size before an exact join."""
    size = power_of_two(TABLE_BITS * hashes.count(), 1 << 10, TABLE_MOST)
    words = (
        hashes.select(F.pmod("hash", F.lit(size)).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 32).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits"))
    )
    table = np.zeros(size // 32, np.uint32)
    for row in words.toLocalIterator():
        table[row["word"]] = row["bits"]
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the table; never false for one that is."""
    at = hashes.view(np.uint64) & np.uint64(len(table) * 32 - 1)
    bits = table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)
    return (bits & np.uint32(1)).astype(bool)
