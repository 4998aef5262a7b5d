"""Importance resampling towards a target distribution, on hashed n-grams.

1. ``ngram_hashes`` lower-cases A-Z and collapses separators to single spaces. One overlapped
   ``finditer`` with boundary lookarounds starts a match at every word; the ends of its
   groups are the ends of the n-grams that start there, so spans go to the CRC directly
   and a longer n-gram goes on with the CRC of the shorter one.
2. Every task sums a flat array of bucket counts; the sums over the tasks give the gain
   of every bucket, log of target share over corpus share (both smoothed by one). At most
   ``buckets`` numbers come to the driver.
3. A document's weight is the floored mean of its features' gains. Gumbel noise from a
   hash of the id turns a draw by weight into a ranking, so draws are repeatable.
4. ``draw`` sorts rows by range partitions and numbers them with the partitions' counts,
   so no task sees all rows.

Words are runs of digits, a-z and all characters from U+0080 on. Null and empty texts have
no features and weight 0. Very long texts are scanned whole. A null id has the hash of the
seed alone and comes after equal scores. Repeated rows are drawn one by one. An empty
corpus gives no rows, an empty target gains below those of any other. Extra columns may be
kept (``keep``); those named like a result column are not.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.llm.common import given_fields, slices, stash

_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def ngram_pattern(longest: int):
    """A match at every word start; group k ends where the run of k words ends."""
    import regex

    tail = b""
    for _ in range(longest - 1):
        tail = rb"(?:( [^ ]++)" + tail + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]++)(?![^ ])" + tail)


def ngram_hashes(text: bytes, pattern) -> tuple[np.ndarray, int]:
    """CRC-32 of every run of words, repeats included, and the number of words."""
    words = text.translate(_LETTERS).split()
    text = b" ".join(words)
    out, groups = array("I"), range(1, pattern.groups + 1)
    add = out.append
    for match in pattern.finditer(text, overlapped=True):
        at, crc = match.start(), 0
        for group in groups:
            end = match.end(group)
            if end < 0:
                break
            crc = crc32(text[at:end], crc)
            add(crc)
            at = end
    return np.array(out, np.uint32), len(words)


def features(documents: DataFrame, *, keep: list[str], text_column: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """The kept columns with ``n_words`` and ``buckets``, the little-endian 32-bit buckets of all n-grams."""
    kinds = documents.select(*keep).schema
    schema = T.StructType([*kinds.fields, T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = ngram_pattern(longest)
        for batch in slices(batches):
            n_words, found = [], []
            for text in batch.column(batch.num_columns - 1):
                hashes, words = ngram_hashes(text.as_py() or b"", pattern)
                n_words.append(words)
                found.append((hashes % np.uint32(buckets)).astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(found, pa.binary())],
                names=[*keep, "n_words", "buckets"],
            )

    return documents.select(*keep, F.col(text_column).cast("binary").alias("__text")).mapInArrow(scan, schema)


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often every bucket occurs: one array a task, then one number a bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    sums = found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of every bucket, each count raised by one."""
    total, wanted, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratios = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (total + n) / ((s + 1.0) * (wanted + n)))) for s, t in ratios], np.int64
    )


def gumbel(doc_id: int | None, seed: int) -> int:
    """Noise of one document, in thousandths."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gains: np.ndarray, *, id_column: str = "doc_id", seed: int = 7) -> DataFrame:
    """``found`` without its buckets, with ``n_features``, ``weight`` and ``score``."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"
    sent = found.sparkSession.sparkContext.broadcast(gains)
    names = [c for c in found.columns if c != "buckets"]
    added = ["n_features", "weight", "score"]
    schema = T.StructType([*found.select(*names).schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in slices(batches):
            sizes, weights, scores = [], [], []
            for doc_id, b in zip(batch.column(id_column).to_pylist(), batch.column("buckets"), strict=True):
                gain = table[np.frombuffer(b.as_buffer(), kind)]
                sizes.append(len(gain))
                weights.append(int(gain.sum()) // len(gain) if len(gain) else 0)
                scores.append(weights[-1] + gumbel(doc_id, seed))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in (sizes, weights, scores))],
                names=[*names, *added],
            )

    return found.mapInArrow(weigh, schema)


def draw(rows: DataFrame, *, percent: int, least_words: int, id_column: str = "doc_id") -> DataFrame:
    """``rows`` with ``rank``: the highest scores of ``percent`` hundredths of the rows of ``least_words``, others null.

    ``rows`` must be a written table, whose row numbers are the same in a repeated task.
    """
    long = F.col("n_words") >= least_words
    order = [F.desc("__long"), F.desc("score"), F.asc_nulls_last(id_column), F.asc("__row")]
    numbered = rows.withColumn("__long", long).withColumn("__row", F.monotonically_increasing_id())
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    placed = stash(
        numbered.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("__row")
        .withColumn("__task", F.spark_partition_id())
        .withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    counts = placed.groupBy("__task").agg(F.count("*").alias("n"), F.count_if("__long").alias("long")).orderBy("__task").collect()
    taken, before, firsts = sum(r["long"] for r in counts) * percent // 100, 0, []
    for row in counts:
        firsts.append((row["__task"], before))
        before += row["n"]
    starts = session.createDataFrame(firsts, "__task int, __first long")  # a row for every task of the sort
    rank = F.col("__first") + F.col("__place") + 1
    return (
        placed.join(F.broadcast(starts), "__task")
        .withColumn("rank", F.when(F.col("__long") & (rank <= taken), rank))
        .drop("__task", "__first", "__place", "__long")
    )


def resample(
    documents: DataFrame,
    target: DataFrame,
    *,
    keep: list[str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = 2,
    buckets: int = 10_000,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """All documents with n_words, n_features, weight, score and, for those drawn, rank.

    ``keep`` are the columns of the documents that the result has, all by default.
    """
    added = {"n_words", "buckets", "n_features", "weight", "score", "rank"}
    keep = list(dict.fromkeys([id_column, *given_fields(documents, keep, without=added)]))
    options = {"text_column": text_column, "longest": longest, "buckets": buckets}
    found = stash(features(documents, keep=keep, **options), "features")
    wanted = bucket_counts(features(target, keep=[], **options), buckets)
    gains = bucket_gains(bucket_counts(found, buckets), wanted)
    rows = stash(scored(found, gains, id_column=id_column, seed=seed), "scored")
    return draw(rows, percent=percent, least_words=least_words, id_column=id_column)
