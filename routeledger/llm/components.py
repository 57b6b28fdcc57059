"""Connected components of an edge table, as rounds of joins (no edge or label reaches the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every endpoint of ``edges(a, b)``: root is the least node of its component.

    Alternating large-star and small-star rounds: each round links the neighbours
    of a node to their least, so the edges of a component become one star in a
    number of rounds that grows as the logarithm of its width.  A node of high
    degree is aggregated by partial minima and its rows meet only in a join
    that adaptive execution may split.  After at most ``rounds`` rounds a component may
    still be in parts, each under a root of its own.  No edges: no rows.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "edges")
    before, done = _print(e), 0
    while rounds is None or done < rounds:  # no round has more edges than the last
        done += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v")).where("u <> v"))
        e = staged(small, "edges")
        if done == rounds:
            break
        now = _print(e)
        if now == before:
            break
        before = now
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")))
    return ends.groupBy("node").agg(F.min("root").alias("root"))
