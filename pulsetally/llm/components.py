"""Connected components by alternating stars, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import stash

#: Rounds grow with the logarithm of a component's size.
ROUNDS_MAX = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for nodes of edges (a, b).

    Every round points nodes at the smallest neighbour of a neighbour, and is written
    to the shared folder. A node with very many neighbours only adds rows to a minimum.
    """
    edges = stash(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    before = _state(edges)
    for _ in range(ROUNDS_MAX):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        edges = stash(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
