"""Exact Jaccard join of shingle sets by prefixes of token combinations.

1. One pass makes a row for every document: the number of shingles, a 64-bit digest of
   the set (the node: equal sets are one node) and an odd sketch. The same pass counts
   shingles inside chunks; sums of these counts give the frequent class.
2. Shingles are ordered rare class first (by hash), then the frequent by their counts. Two
   sets that link share a shingle in their prefixes. Rare prefix shingles are indexed
   singly. If the rare ones do not fill a prefix, it is extended by one, and pairs of its
   frequent shingles are indexed (single frequent ones for large sets, where pairs would be
   too many). A document emits keys once a task for each node, so copies do not pile up.
3. At the first key that two sets share, all shingles before it are in one of them only.
   So a key carries the number of these shingles, and the sum over both sets bounds the
   symmetric difference. Keys with up to ``BUCKET`` nodes give their pairs that pass this
   and the size filter. Larger ones give pairs with a few pivots only, the nodes with
   the fewest shingles before the key.
4. Pairs are checked against the sketches' bound of the symmetric difference, then
   against whole sets, of which only those needed are made again and moved.
5. Links join to components. In keys with more than ``BUCKET`` nodes, those outside the
   main component are compared with the nodes of other components by both filters and by
   sketch, block against block, so that no link between components is lost. Only pairs
   that pass are given out; large keys are dealt over several tasks.

The classes, pivots and bounds only save work; the links do not depend on them.

Null or empty texts have no shingles and link to nothing. Rows with a null id get no
component and take no part in links. Rows with equal ids are documents of their own,
with the same id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import bit_table, hash64, in_table, release_memory, slices, stash
from pulsetally.llm.components import components
from pulsetally.llm.shingles import Shingler, odd_distance, odd_sketch

#: A shingle is frequent from this many documents, or this share of them (bounds the table of frequent ones).
FREQUENT, FREQUENT_SHARE = 64, 1e-4
#: Shingles that are counted at once, and the count from which a chunk reports one.
CHUNK, REPORTED = 2_000_000, 4
#: Largest set whose frequent shingles are indexed in pairs.
PAIRED = 128
#: Nodes of a key that are compared with each other; keys with more use pivots.
BUCKET, PIVOTS = 16, 2
#: Nodes outside a main component, and nodes of a key, that are compared in one group; pairs of them at once.
OUTSIDE, STREAMED, PAIRS = 1024, 8192, 1 << 13
#: Sets a task remembers to have emitted.
SEEN_MAX = 1_000_000
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _batch(columns: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(hash64(shingles.tobytes())).astype(np.int64))


def _sets(documents: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, node, odd) of every document, and (token, count) of chunk counts."""
    docs = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("odd", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, waiting = Shingler(size), [], 0

        def reported() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            counts = np.diff(np.concatenate((starts, [len(tokens)])))
            many = counts >= REPORTED
            none = [None] * int(many.sum())
            return _batch({"doc_id": none, "mark": none, "n": none, "node": none, "odd": none, "token": tokens[starts][many].view(np.int64), "count": counts[many]}, docs)

        for batch in slices(batches):
            sets = [shingler.of(t.as_py()) for t in batch.column(1)]
            none = [None] * len(sets)
            yield _batch(
                {
                    "doc_id": batch.column(0), "mark": batch.column(2), "n": [len(s) for s in sets],
                    "node": [_node(s) if len(s) else None for s in sets],
                    "odd": [odd_sketch(s) for s in sets], "token": none, "count": none,
                },
                docs,
            )
            for s in sets:
                if len(s):
                    held.append(s)
                    waiting += len(s)
            if waiting >= CHUNK:
                yield reported()
                held, waiting = [], 0
        if held:
            yield reported()

    marked = documents.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = stash(
        marked.mapInArrow(scan, "doc_id long, mark long, n long, node long, odd binary, token long, count long"), "shingle-sets"
    )
    return (
        found.filter("n IS NOT NULL").select("doc_id", "mark", "n", "node", "odd"),
        found.filter("token IS NOT NULL").select("token", "count"),
    )


def _ordered(shingles: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rare shingles by hash, and the frequent ones by rank."""
    if not len(frequent):
        return shingles, shingles[:0]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    is_frequent = frequent[at] == shingles
    common = shingles[is_frequent]
    return shingles[~is_frequent], common[np.argsort(ranks[at[is_frequent]])]


def prefix_keys(
    shingles: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each the number of other shingles before its last one in the order.

    ``frequent`` are in order of hash, ``ranks`` their places by count.
    """
    n = len(shingles)
    prefix = n + (-percent * n // 100) + 1  # n less the least overlap, plus one
    rare, common = _ordered(shingles, frequent, ranks)
    keys, places = [rare[:prefix]], [np.arange(min(prefix, len(rare)))]
    first = prefix - len(rare)
    if first > 0 and n > 1:
        if n * percent <= PAIRED * 100:
            part = common[: first + 1]
            i, j = np.triu_indices(len(part), 1)
            i, j = i[i < first], j[i < first]
            keys.append((part[i] * _MIX) ^ (part[j] >> np.uint64(1)) ^ (part[j] << np.uint64(63)))
            places.append(len(rare) + j - 1)
        if n > PAIRED:
            keys.append(common[:first])
            places.append(len(rare) + np.arange(len(common[:first])))
    return np.concatenate(keys), np.concatenate(places)


def _keys(documents: DataFrame, size: int, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(key, node, n, place) of every document, each node once a task."""
    sent = documents.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([(c, pa.int64()) for c in ("key", "node", "n", "place")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), set()
        for batch in slices(batches):
            keys, places, nodes, sizes = [], [], [], []
            for t in batch.column(1):
                shingles = shingler.of(t.as_py())
                if not len(shingles) or (node := _node(shingles)) in seen:
                    continue
                if len(seen) < SEEN_MAX:
                    seen.add(node)
                k, p = prefix_keys(shingles, *sent.value, percent)
                keys.append(k)
                places.append(p)
                nodes.append(np.full(len(k), node))
                sizes.append(np.full(len(k), len(shingles)))
            if keys:
                yield _batch(
                    {
                        "key": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes),
                        "n": np.concatenate(sizes), "place": np.concatenate(places),
                    },
                    schema,
                )

    return documents.mapInArrow(emit, "key long, node long, n long, place long")


def may_link(n, place, other_n, other_place, percent: int):
    """The filters by place and size, for numbers, arrays or columns.

    At the first key of two sets the shingles before it are not shared, so the symmetric
    difference is at least the sum of the places.
    """
    least, most = (F.least, F.greatest) if isinstance(n, Column) else (np.minimum, np.maximum)
    return ((place + other_place) * (100 + percent) <= (100 - percent) * (n + other_n)) & (
        least(n, other_n) * 100 >= percent * most(n, other_n)
    )


def _bucket_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) to check, and rows (key, a, n, place) of the nodes of large keys."""
    names = ("key", "a", "b", "n", "place")
    schema = pa.schema([(c, pa.int64()) for c in names])
    upper = [np.triu_indices(m, 1) for m in range(BUCKET + 1)]

    def rows(key, a, b, n=None, place=None) -> pa.RecordBatch:
        none = [None] * len(a)
        return _batch(
            {"key": none if key is None else key, "a": a, "b": none if b is None else b, "n": none if n is None else n, "place": none if place is None else place},
            schema,
        )

    def pairs_of(part: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs of the small keys, those with equal counts together."""
        for m in np.unique(counts).tolist():
            i, j = upper[m]
            at = starts[counts == m][:, None]
            x, y = part[at + i].reshape(-1, 4), part[at + j].reshape(-1, 4)
            ok = may_link(x[:, 2], x[:, 3], y[:, 2], y[:, 3], percent)
            yield np.stack((x[ok, 1], y[ok, 1]), axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held = np.zeros((0, 4), np.int64)  # rows of the last key that is not known to be complete
        pivots = None  # set while the rows of one large key stream through

        def large(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield rows(part[:, 0], part[:, 1], None, part[:, 2], part[:, 3])
            for pivot in pivots:
                ok = may_link(part[:, 2], part[:, 3] * 0, pivot[2], 0, percent) & (part[:, 1] != pivot[1])
                yield rows(None, np.full(int(ok.sum()), pivot[1]), part[ok, 1])

        for batch in batches:
            new = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            if pivots is not None:
                same = int(np.searchsorted(new[:, 0] != pivots[0, 0], True))
                if same:
                    yield from large(new[:same])
                    new = new[same:]
                if len(new):
                    pivots = None
            part = np.concatenate((held, new)) if len(held) else new
            if not len(part):
                continue
            # Copies of a node that other tasks emitted are next to each other.
            fresh = np.concatenate(([True], (part[1:, :2] != part[:-1, :2]).any(axis=1)))
            part = part[fresh]
            starts = np.flatnonzero(np.concatenate(([True], part[1:, 0] != part[:-1, 0])))
            counts = np.diff(np.concatenate((starts, [len(part)])))
            held = part[starts[-1] :]
            whole_starts, whole_counts = starts[:-1], counts[:-1]
            small = (whole_counts > 1) & (whole_counts <= BUCKET)
            found = list(pairs_of(part, whole_starts[small], whole_counts[small]))
            if found:
                unique = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
                yield rows(None, unique[:, 0], unique[:, 1])
            for at in np.flatnonzero(whole_counts > BUCKET).tolist():
                whole = part[whole_starts[at] : whole_starts[at] + whole_counts[at]]
                pivots = whole[:PIVOTS]
                yield from large(whole)
                pivots = None
            if len(held) > BUCKET:
                pivots = held[:PIVOTS].copy()
                yield from large(held)
                held = held[:0]
        if len(held) > 1:
            found = list(pairs_of(held, np.zeros(1, np.int64), np.array([len(held)])))
            yield rows(None, found[0][:, 0], found[0][:, 1])

    return (
        keys.repartition("key")
        .sortWithinPartitions("key", "place", "node")
        .mapInArrow(scan, "key long, a long, b long, n long, place long")
    )


def _linked(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, checked by sketch and then by whole sets."""

    def side(frame: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return frame.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, n, odd, other_n, other_odd = (batch.column(c).to_pylist() for c in ("a", "b", "a_n", "a_odd", "b_n", "b_odd"))
            keep = [
                odd_distance(odd[i], other_odd[i]) * (100 + percent) <= (100 - percent) * (n[i] + other_n[i])
                for i in range(len(a))
            ]
            yield batch.select(["a", "b", "a_doc", "b_doc"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    maybe = stash(
        pairs.join(side(nodes, "a", ["n", "odd", "doc"]), "a")
        .join(side(nodes, "b", ["n", "odd", "doc"]), "b")
        .mapInArrow(near, "a long, b long, a_doc long, b_doc long"),
        "near-pairs",
    )
    if maybe.isEmpty():
        return maybe.select("a", "b")
    wanted = maybe.select(F.explode(F.array("a_doc", "b_doc")).alias("doc")).select(F.xxhash64("doc").alias("hash"))
    table = documents.sparkSession.sparkContext.broadcast(bit_table(wanted))
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            keep = in_table(table.value, batch.column(2).to_numpy(zero_copy_only=False))
            sets = [shingler.of(t) for t in batch.column(1).filter(pa.array(keep)).to_pylist()]
            sets = [s for s in sets if len(s)]
            yield _batch({"node": [_node(s) for s in sets], "shingles": [s.tobytes() for s in sets]}, schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch.column("a_shingles"), batch.column("b_shingles"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * 100 >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = documents.withColumn("hash", F.xxhash64("doc_id")).mapInArrow(again, "node long, shingles binary")
    ends = maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stash(sets.join(ends, "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    return stash(
        maybe.select("a", "b")
        .join(side(sets, "a", ["shingles"]), "a")
        .join(side(sets, "b", ["shingles"]), "b")
        .mapInArrow(check, "a long, b long"),
        "links",
    )


def _parted(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes of the large keys that lie in several components: (key, node, n, place, component, main, most, total)."""
    own = large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("nodes"))
    main = (
        sizes.groupBy("key")
        .agg(
            F.max_by("component", F.struct("nodes", "component")).alias("main"),
            F.max("nodes").alias("most"), F.sum("nodes").alias("total"), F.count("*").alias("parts"),
        )
        .filter("parts > 1")
    )
    return stash(own.join(main.drop("parts"), "key"), "parted-keys")


def _outside(parted: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a node outside its key's main component and one of another component.

    They pass the filters and the bound by their sketches. The nodes outside are dealt in
    blocks of about ``OUTSIDE``, all nodes of the key in blocks of about ``STREAMED``; every
    pair of blocks is a group of its own, in which the second block streams by.
    """
    rows = parted.join(nodes.select("node", "odd"), "node").select(
        "key", "node", "n", "place", "component", (F.col("component") == F.col("main")).alias("inside"), "odd",
        F.ceil((F.col("total") - F.col("most")) / OUTSIDE).cast("int").alias("lefts"),
        F.ceil(F.col("total") / STREAMED).cast("int").alias("rights"),
    )

    def dealt(column: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(column)).cast("int")

    def every(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    names = ["key", "left", "right", "second", "node", "n", "place", "component", "inside", "odd"]
    first = rows.filter("NOT inside").withColumns({"left": dealt("lefts"), "right": every("rights"), "second": F.lit(False)})
    second = rows.withColumns({"left": every("lefts"), "right": dealt("rights"), "second": F.lit(True)})
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in slices(batches):
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "left", "right")], axis=1)
            edges = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if tuple(ids[lo]) != group:
                    group, held = tuple(ids[lo]), []
                part = batch.slice(lo, hi - lo)
                is_second = part.column("second").to_numpy(zero_copy_only=False)
                at = int(np.searchsorted(is_second, True))
                if at:
                    held.append(_Block(part.slice(0, at)))
                if at < part.num_rows:
                    block = _Block(part.slice(at))
                    for left in held:
                        a, b = left.near(block, percent)
                        if len(a):
                            yield _batch({"a": a, "b": b}, schema)

    return (
        first.select(*names).unionByName(second.select(*names))
        .repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "second", "place", "node")
        .mapInArrow(compare, "a long, b long")
    )


class _Block:
    """Nodes of one key as arrays, and their sketches by length."""

    def __init__(self, rows: pa.RecordBatch):
        self.node, self.n, self.place, self.component = (rows.column(c).to_numpy() for c in ("node", "n", "place", "component"))
        self.inside = rows.column("inside").to_numpy(zero_copy_only=False)
        odd = [o.as_buffer() for o in rows.column("odd")]
        self.words = np.array([len(o) // 8 for o in odd])
        self.sketches = {
            size: (np.flatnonzero(self.words == size), np.stack([np.frombuffer(o, np.uint64) for o in odd if len(o) == 8 * size]))
            for size in np.unique(self.words).tolist()
        }

    def near(self, other: _Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that may link, by filters and sketches."""
        n, place, node = self.n[:, None], self.place[:, None], self.node[:, None]
        maybe = may_link(n, place, other.n, other.place, percent) & (self.component[:, None] != other.component)
        maybe &= other.inside | (node < other.node)
        found = []
        for size, (rows, left) in self.sketches.items():
            for other_size, (columns, right) in other.sketches.items():
                small = min(size, other_size)
                x, y = _folded(left, small), _folded(right, small)
                i, j = np.nonzero(maybe[np.ix_(rows, columns)])
                for at in range(0, len(i), PAIRS):
                    p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                    apart = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64)
                    sizes = self.n[rows[p]] + other.n[columns[q]]
                    ok = apart * (100 + percent) <= (100 - percent) * sizes
                    found.append(np.stack((self.node[rows[p[ok]]], other.node[columns[q[ok]]])))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return a, b


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches made as if for smaller sets."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links; only the components these join are worked on."""

    def named(side: str) -> DataFrame:
        return labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))

    edges = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    joined = components(
        edges.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    ).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = labels.unionByName(new).join(joined, "component", "left")
    return stash(every.select("node", F.coalesce("whole", "component").alias("component")), "labels")


def jaccard_components(
    documents: DataFrame,
    *,
    words: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): sets link from ``percent`` hundredths of Jaccard similarity.

    ``component_id`` is the smallest id that is reachable by links, itself included.
    """
    return _classes(documents, words, percent, id_column, text_column).select("doc_id", "n_shingles", "component_id")


def _classes(documents: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """Rows (doc_id, mark, n_shingles, component, component_id); ``mark`` is a hash of the text."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, as pairs of frequent shingles need an overlap of two")
    documents = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows, counts = _sets(documents, words)
    known = documents.filter("doc_id IS NOT NULL")
    total = rows.count()
    least = max(FREQUENT, int(total * FREQUENT_SHARE))
    often = counts.groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)
    both = np.array([(r["token"], r["count"]) for r in often.toLocalIterator()], np.int64).reshape(-1, 2)
    tokens = both[:, 0].copy().view(np.uint64)
    order = np.argsort(tokens)
    ranks = np.empty(len(order), np.int32)
    ranks[np.lexsort((tokens, both[:, 1]))] = np.arange(len(order))
    frequent = (tokens[order], ranks[order])
    nodes = stash(
        rows.filter("node IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("odd").alias("odd")),
        "nodes",
    )
    found = stash(_bucket_pairs(_keys(known, words, frequent, percent), percent), "key-pairs")
    links = _linked(found.filter("b IS NOT NULL").select("a", "b"), nodes, known, words, percent)
    labels = components(links)
    large = found.filter("key IS NOT NULL").select("key", F.col("a").alias("node"), "n", "place").distinct()
    parted = _parted(large, labels)
    if not parted.isEmpty():
        more = _linked(_outside(parted, nodes, percent), nodes, known, words, percent)
        if not more.isEmpty():
            labels = _merged(labels, more)
    ids = (
        nodes.select("node", "doc")
        .join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    smallest = ids.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = stash(ids.join(smallest, "component").select("node", "component", "component_id"), "node-components")
    known_id = F.col("doc_id").isNotNull()
    return rows.join(named, "node", "left").select(
        "doc_id", "mark",
        F.col("n").alias("n_shingles"),
        F.when(known_id, F.col("component")).alias("component"),
        F.when(known_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def keep_one(
    documents: DataFrame, *, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``documents`` with one row of every component: that with the smallest id.

    Rows with equal ids are judged by their own texts, and of equal rows one stays. Rows
    without an id or without words stay.
    """
    rows = _classes(documents, words, percent, id_column, text_column).filter("component IS NOT NULL")
    own = stash(rows.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows")), "component-rows")
    first = F.struct("doc_id", "mark")
    kept = own.groupBy("component").agg(F.min(first).alias("kept"))
    extra = own.join(kept, "component").filter(first != F.col("kept")).select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")
    ).distinct()
    marked = documents.withColumns({"__id": F.col(id_column).cast("long"), "__mark": F.xxhash64(text_column)})
    out = marked.join(extra, ["__id", "__mark"], "left_anti")
    repeated = own.filter("rows > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    if not repeated.isEmpty():
        once = out.join(repeated, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"])
        out = out.join(repeated, ["__id", "__mark"], "left_anti").unionByName(once)
    return out.select(*documents.columns)
