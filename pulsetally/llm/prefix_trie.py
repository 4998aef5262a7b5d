"""Prefix trie of conversations on flat arrays behind minimal perfect hashes.

1. ``conversation_paths`` hashes every turn before the shuffle, orders the hashes by
   conversation and chains them to prefix digests: a row (digests, sizes) a conversation.
   Conversations of a family may take their first turns from its head.
2. Members of every distinct prefix are counted (sums combine before the shuffle).
   Prefixes with more than ``1 / HEAVY_SHARE`` of all conversations, and ``HEAVY_LEAST``
   at least, are heavy. At every depth there are fewer than ``HEAVY_SHARE`` of them.
3. Paths are cut where they leave the heavy part. What hangs below is a light subtree of
   few conversations; ``SHARDS`` gather light subtrees. In each shard ``SlotTable`` gives every
   distinct digest a slot, a minimal perfect hash whose slots are verified with the
   digests; counts are scattered into arrays by slot, and leaves and saved bytes are
   added to parent slots, deepest nodes first.
4. The heavy part is one more table, with the sums of the light subtrees of each heavy
   parent as start values. So a first turn or a whole conversation that a third of all
   conversations share is counted, and never gathered.
5. Ids that end at a heavy node are sorted by range partitions, joined to chunks, and
   the chunks are hashed as a stream.

Turns are ordered by number (null first), then role, then the hash of the turn. Null roles and
texts are empty. Rows without a conversation id belong to none and are left out.
Repeated rows are turns of their own. Extra columns are ignored. An empty table gives no
nodes. A conversation is one value, very long ones too (24 bytes a turn; texts are hashed whole).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import slices, stash

PATHS = "conv_id long, digests binary, sizes array<long>"
NODES = (
    "digest binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
)
#: A prefix is heavy above this share of the conversations, and from this many.
HEAVY_SHARE, HEAVY_LEAST = 10_000, 64
#: Turns of a shard, on average.
SHARD_TURNS = 500_000
#: Ids of a chunk.
CHUNK = 50_000
DIGEST = 16
ROOT = hashlib.sha256(b"").digest()[:DIGEST]
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, seed) -> np.ndarray:
    """64 bits of two-word keys under a seed, or an array of seeds."""
    h = keys[..., 0] ^ (np.asarray(seed, np.uint64) * _ODD)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + keys[..., 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class SlotTable:
    """A minimal perfect hash: distinct keys (rows of two words) get the slots 0 to n - 1.

    Keys fall into buckets of two on average. Buckets are placed largest first, each by
    the first seed that sends its keys to free slots; buckets of one key take the slots
    left over. ``slots`` verifies every answer with the stored key.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.buckets = max(1, n // 2)
        self.keys = np.zeros_like(keys)
        self.shift = np.zeros(self.buckets, np.int64)  # a seed, or -1 - slot
        bucket = (_mix(keys, 0) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, starts, counts = np.unique(bucket[order], return_index=True, return_counts=True)
        free = np.ones(n, bool)
        for size in np.unique(counts[counts > 1])[::-1].tolist():
            chosen = counts == size
            waiting, rows, seed = names[chosen], order[starts[chosen][:, None] + np.arange(size)], 0
            while len(waiting):
                seed += 1
                if seed == 1000 and len(_distinct(keys)) < n:
                    raise ValueError("two keys are equal")
                to = (_mix(keys[rows], seed) % np.uint64(n)).astype(np.int64)
                _, first = np.unique(to, return_index=True)
                claimed = np.zeros(to.size, bool)
                claimed[first] = True
                placed = (claimed.reshape(to.shape) & free[to]).all(axis=1)
                free[to[placed]] = False
                self.keys[to[placed].ravel()] = keys[rows[placed].ravel()]
                self.shift[waiting[placed]] = seed
                waiting, rows = waiting[~placed], rows[~placed]
        single, left = counts == 1, np.flatnonzero(free)
        self.shift[names[single]] = -1 - left
        self.keys[left] = keys[order[starts[single]]]
        if n and (self.slots(keys) < 0).any():
            raise ValueError("a key has no slot of its own")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for keys that are not in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        shift = self.shift[(_mix(keys, 0) % np.uint64(self.buckets)).astype(np.int64)]
        hashed = (_mix(keys, np.maximum(shift, 0)) % np.uint64(len(self.keys))).astype(np.int64)
        slot = np.where(shift < 0, -1 - shift, hashed)
        return np.where((self.keys[slot] == keys).all(axis=1), slot, -1)


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    return keys[np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))] if len(keys) else keys


def accumulate(parent: np.ndarray, depth: np.ndarray, *totals: np.ndarray) -> None:
    """Add every node's totals to those of its parent slot, deepest nodes first; -1 is no parent."""
    order = np.argsort(-depth, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(depth[order]) != 0, [True]))) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        nodes = order[a:b]
        nodes = nodes[parent[nodes] >= 0]
        for total in totals:
            np.add.at(total, parent[nodes], total[nodes])


def _agreed(size: int, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One value a slot; rows of a slot that differ mean that two prefixes have one digest."""
    out = np.zeros(size, values.dtype)
    out[slots] = values
    if (out[slots] != values).any():
        raise ValueError("two prefixes have the same digest")
    return out


def conversation_paths(turns: DataFrame, *, family: Column | None = None, taken: Column | None = None) -> DataFrame:
    """The prefix digests of every conversation of ``turns`` (conv_id, turn, role, text).

    ``family`` names, from the id, the conversation whose first ``taken`` turns replace
    the conversation's own first turns: all it has, none if it is absent.
    """
    role, text = (F.coalesce(c, F.lit("")).cast("binary") for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        (F.col("conv_id") if family is None else family).cast("long").alias("family"), F.col("conv_id").cast("long").alias("conv_id"),
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role, text), 256)).alias("hash"),
        F.octet_length(text).cast("long").alias("size"), (F.lit(0) if taken is None else taken).cast("long").alias("taken"),
    )
    schema = pa.schema([("conv_id", pa.int64()), ("digests", pa.binary()), ("sizes", pa.list_(pa.int64()))])
    sha = hashlib.sha256

    def path(turns: list[tuple[bytes, int]]) -> tuple[bytes, list[int]]:
        digest, out = ROOT, []
        for turn, _ in turns:
            digest = sha(digest + turn).digest()[:DIGEST]
            out.append(digest)
        return b"".join(out), [size for _, size in turns]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = conv = None
        head, own, take, done = [], [], 0, []

        def rebuilt() -> tuple:
            nonlocal head
            if conv == group:
                head = own
            return (conv, *path([*head[:take], *own[take:]]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("family", "conv_id", "hash", "size", "taken"))
            for family_id, conv_id, turn, size, n in zip(*columns, strict=True):
                if conv_id != conv:
                    if conv is not None:
                        done.append(rebuilt())
                    if family_id != group:
                        group, head = family_id, []
                    conv, own, take = conv_id, [], n
                own.append((turn, size))
            if done:
                yield batch_of(done)
                done = []
        if conv is not None:
            yield batch_of([*done, rebuilt()])

    order = [F.asc("family"), F.asc("other"), F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("hash")]
    return (
        rows.withColumn("other", F.col("conv_id") != F.col("family"))
        .repartition("family").sortWithinPartitions(*order).mapInArrow(chain, PATHS)
    )


def _prefixes(paths: DataFrame) -> DataFrame:
    """(digest, parent, depth, size, n_convs, conv_id) of all distinct prefixes, the root too."""
    part = "substring(digests, {0}, 16)".format
    below = (
        paths.select("conv_id", "digests", F.posexplode("sizes").alias("at", "size"))
        .select(
            F.expr(part("16 * at + 1")).alias("digest"),
            F.when(F.col("at") == 0, F.lit(ROOT)).otherwise(F.expr(part("16 * at - 15"))).alias("parent"),
            (F.col("at") + 1).cast("long").alias("depth"), "size", "conv_id",
        )
    )
    root = paths.select(
        F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("size"), "conv_id",
    )
    keys = ["digest", "parent", "depth", "size"]
    return below.unionByName(root).groupBy(*keys).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))


SUFFIX = "conv_id long, top binary, parent binary, parent_conv_id long, above long, digests binary, sizes array<long>"


def _split(paths: DataFrame, heavy: dict[bytes, int], light: bool) -> DataFrame:
    """What hangs below the heavy part of every path, or (conv_id, digest) of paths that end in it."""
    sent = paths.sparkSession.sparkContext.broadcast(heavy)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    ddl = SUFFIX if light else "conv_id long, digest binary"
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in slices(batches):
            out = []
            for conv_id, digests, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last, at = ROOT, 0
                while at < len(sizes) and (here := digests[DIGEST * at : DIGEST * (at + 1)]) in known:
                    last, at = here, at + 1
                if (at < len(sizes)) != light:
                    continue
                rest = digests[DIGEST * at :]
                out.append((conv_id, rest[:DIGEST], last, known[last], at, rest, sizes[at:]) if light else (conv_id, last))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    return paths.mapInArrow(cut, ddl)


def _hash_ids(slots: np.ndarray, ids: np.ndarray, size: int) -> list[str]:
    """For every slot the hash of its ids, ascending and joined by commas."""
    out = [NO_ENDS] * size
    order = np.lexsort((ids, slots))
    slots, ids = slots[order], ids[order]
    edges = np.flatnonzero(np.concatenate(([True], np.diff(slots) != 0, [True]))) if len(slots) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[slots[a]] = hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()
    return out


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes (``NODES``) of the light subtrees of one shard, from rows of ``SUFFIX``."""
    table = table.combine_chunks()
    conv, above, outside = (table.column(c).to_numpy() for c in ("conv_id", "above", "parent_conv_id"))
    sizes = table.column("sizes").to_pylist()
    lengths = np.array([len(s) for s in sizes], np.int64)
    keys = _words(b"".join(table.column("digests").to_pylist()))
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    nodes = SlotTable(_distinct(keys))
    n = len(nodes.keys)
    slot = nodes.slots(keys)
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = _agreed(n, slot, np.arange(len(keys)) - firsts[row] + above[row] + 1)
    size = _agreed(n, slot, np.concatenate([np.array(s, np.int64) for s in sizes]))
    before = np.concatenate(([-1], slot[:-1]))
    before[firsts] = -1
    parent = _agreed(n, slot, before)
    n_convs = np.bincount(slot, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv[row])
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * size
    accumulate(parent, depth, leaves, saved)
    top_conv, top_parent = np.zeros(n, np.int64), [None] * n
    top_conv[slot[firsts]] = outside
    for at, above_digest in zip(slot[firsts].tolist(), table.column("parent").to_pylist(), strict=True):
        top_parent[at] = above_digest
    columns = {
        "digest": [k.tobytes() for k in nodes.keys], "parent": top_parent, "conv_id": least, "depth": depth,
        "parent_conv_id": np.where(parent < 0, top_conv, least[parent]), "n_convs": n_convs, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": _hash_ids(slot[ends - 1], conv, n), "top": parent < 0,
    }
    return pa.table(columns, schema=_NODES_ARROW)


_NODES_ARROW = pa.schema(
    [
        (name, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind])
        for name, kind in (f.split() for f in NODES.split(", "))
    ]
)


def heavy_nodes(table: pa.Table) -> pa.Table:
    """The nodes of the heavy part, from its prefixes and the sums of light subtrees below them."""
    table = table.combine_chunks()
    digests = table.column("digest").to_pylist()
    keys = _words(b"".join(digests))
    nodes = SlotTable(_distinct(keys))
    n, slot = len(nodes.keys), nodes.slots(keys)
    if n != len(digests):
        raise ValueError("two prefixes have the same digest")

    def by_slot(name: str) -> np.ndarray:
        return _agreed(n, slot, table.column(name).to_numpy())

    parent = np.full(n, -1)
    has = np.array([p is not None for p in table.column("parent").to_pylist()], bool)
    if has.any():
        parent[slot[has]] = nodes.slots(_words(b"".join(p for p in table.column("parent").to_pylist() if p is not None)))
    depth, n_convs, conv, size = (by_slot(c) for c in ("depth", "n_convs", "conv_id", "size"))
    children = by_slot("light_children") + np.bincount(parent[parent >= 0], minlength=n)
    leaves = by_slot("light_leaves") + (children == 0)
    saved = by_slot("light_saved") + (n_convs - 1) * size
    accumulate(parent, depth, leaves, saved)
    hashes = dict(zip(slot.tolist(), table.column("ends_sha256").to_pylist(), strict=True))
    columns = {
        "digest": [k.tobytes() for k in nodes.keys], "parent": [None] * n, "conv_id": conv, "depth": depth,
        "parent_conv_id": pa.array(np.where(parent < 0, 0, conv[parent]), mask=parent < 0), "n_convs": n_convs,
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": [hashes[i] for i in range(n)], "top": np.zeros(n, bool),
    }
    return pa.table(columns, schema=_NODES_ARROW)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) from (conv_id, digest): chunks of sorted ids, hashed one after the other."""
    chunks = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    hashes = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((digest, ids[0], ",".join(map(str, ids))), chunks, strict=True)], schema=chunks
            )

        for batch in batches:
            for conv_id, here in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if here != digest or len(ids) >= CHUNK:
                    if ids:
                        yield row()
                    digest, ids = here, []
                ids.append(conv_id)
        if ids:
            yield row()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, sha = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([sha.hexdigest()])], schema=hashes)

        for batch in slices(batches):
            for here, ids in zip(batch.column("digest").to_pylist(), batch.column("ids"), strict=True):
                if here != digest:
                    if sha is not None:
                        yield row()
                    digest, sha = here, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_py().encode())
        if sha is not None:
            yield row()

    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        ends.repartitionByRange(tasks, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
        .mapInArrow(chunk, "digest binary, first long, ids string")
        .repartition("digest").sortWithinPartitions("digest", "first")
        .mapInArrow(join, "digest binary, ends_sha256 string")
    )


def trie_nodes(paths: DataFrame, *, heavy_share: int = HEAVY_SHARE, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """A row for every distinct prefix of ``paths``, a written table of ``conversation_paths``.

    Columns: digest, conv_id (smallest member), depth, parent_conv_id, n_convs (members),
    n_children, n_leaves, saved_tokens (bytes of last texts that other members need not
    repeat, summed over the subtree), ends_sha256 (of the members that end here).
    """
    session = paths.sparkSession
    total, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    bound = max(heavy_least, total // heavy_share)
    heavy = stash(
        _prefixes(paths).filter((F.col("n_convs") > bound) | (F.col("depth") == 0)), "heavy-prefixes"
    )
    known = {bytes(r["digest"]): r["conv_id"] for r in heavy.select("digest", "conv_id").toLocalIterator()}
    shards = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    light = stash(
        _split(paths, known, True)
        .withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)))
        .groupBy("shard").applyInArrow(shard_nodes, NODES),
        "light-nodes",
    )
    below = light.filter("top").groupBy("parent").agg(
        F.count("*").alias("light_children"), F.sum("n_leaves").alias("light_leaves"), F.sum("saved_tokens").alias("light_saved")
    ).withColumnRenamed("parent", "digest")
    hashes = _end_hashes(_split(paths, known, False))
    top = (
        heavy.join(below, "digest", "left").join(hashes, "digest", "left")
        .fillna(0, ["light_children", "light_leaves", "light_saved"]).fillna(NO_ENDS, ["ends_sha256"])
        .withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(heavy_nodes, NODES)
    )
    return light.unionByName(top).drop("parent", "top")
