"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Each round joins every vertex's neighbours to its smallest neighbour; rounds
    grow with the logarithm of the longest path. No edges: no rows. Loops, edges
    with a null end and repeated edges change nothing.
    """
    pair = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    now = staged(pair.distinct(), "edges")
    before = _tally(now)
    while before[0]:
        # large star: neighbours above u move to u's smallest neighbour
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its neighbours below move to the smallest of them
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = staged(moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        after = _tally(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
