"""Shards of near equal bytes by sampled splitters, with DataFrame functions only.

1. Every record gets a key: the hash of its group (equal texts), then the hash of
   its id. Records are thin: key, id, size; texts are read once. Equal records are counted
   into one, and those with many copies are cut into parts with keys of their own.
2. A sample draws each record with a probability in proportion to its size, so
   every drawn key stands for the same number of bytes. Quantiles of the sample are
   splitters of ``RANGES`` times as many ranges as shards. A splitter inside a group
   falls on the group's start, unless the group alone holds more than a range; such a
   group has splitters at its start and end too, so its ranges hold nothing else.
3. Records are range-partitioned by a two-level search in the sorted splitters.
   Exact sizes of the ranges are counted; ranges above ``OVERFULL`` times their share
   are split again by a sample of their own records alone.
4. Ranges (those of one group together), largest first, go to the shard with the fewest bytes so far. A slot is the
   number of records in the shard's earlier ranges plus the place in its own range, so
   no shard is ever sorted in one task.

The driver sees the sample and the range sizes, both bounded by the number of ranges.
Groups stay in one shard unless they are larger than ``KEPT`` of a shard's even share, which
is decided by their exact sizes. The result depends on keys and sizes only, not on the order of the rows.

Null text has size 8 and its own group; null ids are keys as well. Rows that are
repeated whole get slots of their own and are spread as a group is. Very long texts count
by their size; one that is larger than a range has a range of its own. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetally.llm.common import ceil_div, stash

#: Ranges for each shard, and sampled keys for each range.
RANGES, SAMPLED = 32, 16
#: A range is overfull beyond this many times its even share, unless it is a single record.
OVERFULL = 1.5
ROUNDS = 2
#: Copies of one record are cut into parts of this share of a range.
PART = 0.25
#: A group up to this share of a shard's bytes stays together.
KEPT = 0.25
Key = tuple[int, int]
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _drawn(records: DataFrame, total: int, points: int, seed: int) -> DataFrame:
    """Records drawn in proportion to size, ``points`` expected: a hash decides, so a retry draws the same."""
    chance = F.col("bytes").cast("double") * points / total
    dice = F.pmod(F.xxhash64("key_group", "key_row", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return records.filter(dice < chance).select(
        "key_group", "key_row", F.greatest(chance, F.lit(1.0)).alias("weight")
    )


def _splitters(drawn: list[tuple[int, int, float]], ranges: int) -> list[Key]:
    """Keys that start a new range, at even steps of the drawn weight."""
    drawn = sorted(drawn)
    step = sum(w for _, _, w in drawn) / ranges
    groups: dict[int, float] = {}
    for group, _, weight in drawn:
        groups[group] = groups.get(group, 0.0) + weight
    found, seen, due = set(), 0.0, step
    for group, row, weight in drawn:
        if seen >= due - 1e-9:
            found.add((group, _LOW))
            if groups[group] > step:
                found.add((group, row))
                found |= {(group + 1, _LOW)} if group < _HIGH else set()
            due = (seen // step + 1) * step
        seen += weight
    return sorted(found)


def _below(bounds: Column, group: Column, row: Column) -> Column:
    """How many of the sorted bounds are at or below the key."""
    return F.size(
        F.filter(
            bounds,
            lambda b: (b["g"] < group) | ((b["g"] == group) & (b["r"] <= row)),
        )
    )


def _literal(keys: list[Key]) -> str:
    return "array(" + ",".join(f"named_struct('g',{_long(g)},'r',{_long(r)})" for g, r in keys) + ")"


def _long(value: int) -> str:
    return f"({value + 1}L - 1L)" if value == _LOW else f"({value}L)"


def _ranged(records: DataFrame, splitters: list[Key]) -> DataFrame:
    """Adds ``range``: the number of splitters at or below the key, found in two steps."""
    if not splitters:
        return records.withColumn("range", F.lit(0))
    group, row = F.col("key_group"), F.col("key_row")
    wide = max(1, isqrt(len(splitters)))
    blocks = [splitters[i : i + wide] for i in range(0, len(splitters), wide)]
    nested = F.expr(f"array({','.join(map(_literal, blocks))})")
    firsts = F.expr(_literal([b[0] for b in blocks]))
    found = records.withColumn("block", _below(firsts, group, row))
    inside = _below(F.get(nested, F.col("block") - 1), group, row)
    return found.withColumn(
        "range", F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * wide + inside)
    ).drop("block")


def _counted(ranged: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Range -> (bytes, rows, keys); a row for each range at most reaches the driver."""
    counts = F.sum("bytes").alias("bytes"), F.sum("copies").alias("rows"), F.count("*").alias("keys")
    rows = ranged.groupBy("range").agg(*counts).collect()
    return {r["range"]: (r["bytes"], r["rows"], r["keys"]) for r in rows}


def _even(
    sizes: dict[int, tuple[int, int, int]], splitters: list[Key], shards: int
) -> dict[int, tuple[int, int]]:
    """Range -> (shard, slots before it): the largest unit goes to the emptiest shard.

    The ranges of one group are a unit, if that is not above a share of a shard (``KEPT``).
    """
    most = KEPT * sum(b for b, *_ in sizes.values()) / shards
    cut = {group for group, row in splitters if row != _LOW}
    units: dict[tuple[bool, int], list[int]] = {}
    for r in sorted(sizes):
        group = splitters[r - 1][0] if r else None
        units.setdefault((True, group) if group in cut else (False, r), []).append(r)
    parts = []
    for unit in units.values():
        whole = sum(sizes[r][0] for r in unit)
        parts += [(whole, unit)] if whole <= most else [(sizes[r][0], [r]) for r in unit]
    load = [(0, s) for s in range(shards)]
    held: list[list[int]] = [[] for _ in range(shards)]
    for size, unit in sorted(parts, key=lambda p: (-p[0], p[1])):
        filled, shard = load[0]
        heapq.heapreplace(load, (filled + size, shard))
        held[shard] += unit
    placed = {}
    for shard, ranges in enumerate(held):
        slots = 0
        for r in sorted(ranges):
            placed[r] = (shard, slots)
            slots += sizes[r][1]
    return placed


def _in_parts(records: DataFrame, most: int, seed: int) -> DataFrame:
    """Records of at most ``most`` bytes with all their copies, or of one copy, each with a key of its own."""
    parts = F.least(F.col("copies"), F.ceil(F.col("copies") * F.col("size") / most))
    copies = F.floor(F.col("copies") * (F.col("part") + 1) / F.col("parts")) - F.floor(
        F.col("copies") * F.col("part") / F.col("parts")
    )
    return (
        records.withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("copies", copies)
        .select(
            "doc_id", "size", "text_crc32", "key_group", "copies", (F.col("size") * F.col("copies")).alias("bytes"),
            F.xxhash64("doc_id", F.lit(seed), "part").alias("key_row"),
        )
    )


def shard_by_bytes(
    documents: DataFrame,
    shards: int,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    overhead: int = 8,
    seed: int = 17,
) -> DataFrame:
    """Rows doc_id, size, text_crc32, shard, slot: every record in one of ``shards`` shards.

    ``size`` is the UTF-8 length of the text plus ``overhead``.
    """
    text = F.col(text_column)
    records = stash(
        documents.select(
            F.col(id_column).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.when(text.isNull(), 1).otherwise(0)).alias("key_group"),
        )
        .groupBy("doc_id", "size", "text_crc32", "key_group")
        .agg(F.count("*").alias("copies")),
        "shard-records",
    )
    total = records.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    records = _in_parts(records, max(1, int(PART * total / (shards * RANGES))), seed)
    ranges = shards * RANGES
    drawn = _drawn(records, total, ranges * SAMPLED, seed).collect() if total else []
    splitters = _splitters([tuple(r) for r in drawn], ranges) if drawn else []
    ranged = _ranged(records, splitters)
    sizes = _counted(ranged)
    for round_ in range(1, ROUNDS + 1):
        share = total / ranges
        full = {r: ceil_div(b, max(1, int(share))) for r, (b, _, n) in sizes.items() if n > 1 and b > OVERFULL * share}
        if not full:
            break
        chosen = ranged.filter(F.col("range").isin(sorted(full))).select("key_group", "key_row", "bytes", "range")
        points = sum(full.values()) * SAMPLED
        again = _drawn(chosen, sum(sizes[r][0] for r in full), points, seed + round_)
        inner: dict[int, list[tuple[int, int, float]]] = {}
        for row in again.collect():
            key = (row["key_group"], row["key_row"])
            inner.setdefault(bisect_right(splitters, key), []).append((*key, row["weight"]))
        more = {k for r, keys in inner.items() for k in _splitters(keys, full[r])}
        if more <= set(splitters):
            break
        splitters = sorted(more | set(splitters))
        ranged = _ranged(records, splitters)
        sizes = _counted(ranged)
    placed = _even(sizes, splitters, shards)
    last = range(max(placed, default=0) + 1)
    shard_of = F.expr(f"array({','.join(str(placed.get(r, (0, 0))[0]) for r in last)})")
    before = F.expr(f"array({','.join(f'{placed.get(r, (0, 0))[1]}L' for r in last)})")
    order = Window.partitionBy("range").orderBy("key_group", "key_row", "doc_id")
    earlier = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranged.withColumn("place", F.coalesce(earlier, F.lit(0)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            "doc_id", "size", "text_crc32", F.get(shard_of, "range").alias("shard"),
            (F.get(before, "range") + F.col("place") + F.col("copy")).alias("slot"),
        )
    )
