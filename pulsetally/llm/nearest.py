"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks of ``BLOCK`` rows: int8 codes with a scale a vector,
the norm of what rounding left over, and the original floats. Every block of queries
meets every block of candidates once: candidates stay where they were read, and the blocks
of queries come to them, at most ``PASS_BYTES`` at a time. A tile multiplies codes as matrices, which gives each
distance with an error bound (the two rounding norms). A candidate whose lower bound
is above the k-th smallest upper bound of its query can't be among its k nearest; the
others are computed again in double precision from the original vectors. A task keeps
one heap of k for each query over all its tiles, and the k best of all tasks are merged
by rank. Nothing is approximate in the end: bounds only skip candidates that can't win.

The set of queries is meant to be a stated part of the rows. Work is queries times
candidates; memory is two blocks and a heap for each query of the block.

Vectors that are null, empty, all zero, or hold null or non-finite components take no
part. Vectors of different lengths never meet. Ties go to the smaller id; rows with the
query's own id are not its neighbours; repeated ids are candidates of their own. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetally.llm.common import ceil_div

#: Vectors of a block, and queries that are multiplied with a block at once.
BLOCK, ROWS = 4096, 256
#: Packed queries that are sent to all tasks in one pass; more queries take more passes.
PASS_BYTES = 16 << 20
_BLOCKS = (
    "dim int, rows int, ids binary, hashes binary, codes binary, scales binary, rests binary, vectors binary"
)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and upper bounds of the norms of ``vector - scale * code``."""
    wide = vectors.astype(np.float64)
    scales = np.abs(wide).max(axis=1) / 127
    codes = np.rint(wide / scales[:, None]).astype(np.int8)
    rests = np.sqrt(((wide - codes * scales[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes, scales, rests


def bounds(
    left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all Euclidean distances between two blocks.

    Products of codes are whole numbers; parts of 512 components stay exact in float32.
    """
    (a, sa, ra), (b, sb, rb) = left, right
    dots = np.zeros((len(a), len(b)))
    squares_a, squares_b = np.zeros(len(a)), np.zeros(len(b))
    for at in range(0, a.shape[1], 512):
        x, y = a[:, at : at + 512].astype(np.float32), b[:, at : at + 512].astype(np.float32)
        dots += x @ y.T
        squares_a += (x * x).sum(axis=1, dtype=np.float64)
        squares_b += (y * y).sum(axis=1, dtype=np.float64)
    squares = (squares_a * sa**2)[:, None] + squares_b * sb**2
    between = np.sqrt(np.maximum(squares - 2 * dots * sa[:, None] * sb, 0))
    slack = ra[:, None] + rb + 1e-7 * np.sqrt(squares)
    return between - slack, between + slack


def distances(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    total = np.zeros(len(candidates))
    for j in range(len(query)):
        total += (candidates[:, j] - query[j]) ** 2
    return np.sqrt(total)


def _block(ids: np.ndarray, hashes: np.ndarray, vectors: np.ndarray) -> dict:
    codes, scales, rests = quantise(vectors)
    return {
        "dim": vectors.shape[1], "rows": len(ids), "ids": ids.tobytes(), "hashes": hashes.tobytes(),
        "codes": codes.tobytes(),
        "scales": scales.tobytes(), "rests": rests.tobytes(), "vectors": vectors.tobytes(),
    }


def _usable(vector: Column) -> Column:
    """Finite components, none missing, not all zero."""
    number = F.transform(vector, lambda x: x.cast("double"))
    return (
        vector.isNotNull()
        & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(number, lambda x: x != 0)
    )


def _packed(frame: DataFrame, kind: str) -> DataFrame:
    """Blocks of the rows of each task: (dim, rows, ids, codes, ...)."""
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)

    schema = pa.schema(
        [(f.split()[0], pa.int32() if f.endswith("int") else pa.binary()) for f in _BLOCKS.split(", ")]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def blocks(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held[dim], strict=True)]
            at, n = 0, len(columns[0])
            while n - at >= least:
                row = _block(*(c[at : at + BLOCK] for c in columns))
                yield pa.RecordBatch.from_pylist([row], schema)
                at += BLOCK
            held[dim] = [tuple(c[at:] for c in columns)]

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            hashes = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(len(ids), np.int64)
            starts = lists.offsets.to_numpy()
            sizes, values = np.diff(starts), lists.values.to_numpy().astype(dtype)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                part = values[starts[rows][:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[rows], hashes[rows], part))
                if sum(len(h[0]) for h in held[dim]) >= BLOCK:
                    yield from blocks(dim, BLOCK)
        for dim in held:
            yield from blocks(dim, 1)

    return frame.mapInArrow(pack, _BLOCKS)


def _read(row: dict, side: str, dtype: np.dtype):
    n, dim = row[f"{side}rows"], row["dim"]
    coded = (
        np.frombuffer(row[f"{side}codes"], np.int8).reshape(n, dim),
        np.frombuffer(row[f"{side}scales"], np.float64),
        np.frombuffer(row[f"{side}rests"], np.float64),
    )
    vectors = np.frombuffer(row[f"{side}vectors"], dtype).reshape(n, dim)
    return np.frombuffer(row[f"{side}ids"], np.int64), coded, vectors


def merge_tile(heaps: list[list], queries, candidates, k: int) -> None:
    """Take one tile into the heaps of its queries (the worst of the k on top)."""
    query_ids, query_codes, query_vectors = queries
    ids, codes, vectors = candidates
    for at in range(0, len(query_ids), ROWS):
        rows = slice(at, at + ROWS)
        low, high = bounds(tuple(part[rows] for part in query_codes), codes)
        own = query_ids[rows, None] == ids
        low[own], high[own] = np.inf, np.inf
        limits = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(low), np.inf)
        for i, limit in enumerate(limits.tolist()):
            heap = heaps[at + i]
            if len(heap) == k:
                limit = min(limit, -heap[0][0])
            alive = np.flatnonzero((low[i] <= limit) & ~own[i])
            if not len(alive):
                continue
            exact = distances(query_vectors[at + i].astype(np.float64), vectors[alive].astype(np.float64))
            order = np.lexsort((ids[alive], exact))[:k]
            for d, v in zip(exact[order].tolist(), ids[alive[order]].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -v))
                elif (-d, -v) > heap[0]:
                    heapq.heapreplace(heap, (-d, -v))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` nearest other rows: query_id, rank from 1, vec_id, score (the distance).

    Queries that share an id but not the vector are ranked apart (``query_hash``).
    """
    kind = "float" if vectors.schema[vector_column].dataType.elementType.simpleString() == "float" else "double"
    dtype = np.dtype(np.float32 if kind == "float" else np.float64)
    usable = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast(f"array<{kind}>").alias("vector"),
        is_query.alias("asked"),
    ).filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    candidates = _packed(usable.select("vec_id", "vector"), kind)
    asked = (
        usable.filter("asked")
        .select("vec_id", "vector", F.xxhash64("vector").alias("hash"))
        .dropDuplicates(["vec_id", "hash"])
    )
    sizes = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    room = max(1, PASS_BYTES // ((sizes[1] or 1) * (dtype.itemsize + 1) + 32))
    passes = max(1, ceil_div(sizes[0], room))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[bytes, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                queries = _read(row, "q_", dtype)
                block = row["q_ids"] + row["q_vectors"][: 4 * row["dim"]]
                if block not in heaps:
                    hashes = np.frombuffer(row["q_hashes"], np.int64)
                    heaps[block] = (queries[0], hashes, [[] for _ in queries[0]])
                merge_tile(heaps[block][2], queries, _read(row, "", dtype), k)
        for ids, hashes, found in heaps.values():
            rows = [
                (q, h, -v, -d)
                for q, h, heap in zip(ids.tolist(), hashes.tolist(), found, strict=True)
                for d, v in heap
            ]
            if rows:
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_hash", "vec_id", "score"])

    found = None
    for n in range(passes):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", "hash"), F.lit(passes)) == n)
        packed = _packed(part, kind)
        packed = packed.select("dim", *(F.col(c).alias(f"q_{c}") for c in packed.columns if c != "dim"))
        one = candidates.join(F.broadcast(packed), "dim").mapInArrow(
            tiles, "query_id long, query_hash long, vec_id long, score double"
        )
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id", "query_hash").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "query_hash")
    )
