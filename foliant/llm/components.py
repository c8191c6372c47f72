"""Connected components by alternating large-star and small-star rounds, each one join over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import drop_scratch, scratch


def _starred(pairs: DataFrame, keep_self: bool) -> DataFrame:
    """Hangs the neighbours of every u on the least of them: pairs (u, v) -> (v, least), and (u, least) if wanted."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    hung = pairs.join(least, "u").select(F.col("v").alias("x"), "least")
    if keep_self:
        hung = hung.unionByName(least.select(F.col("u").alias("x"), "least"))
    return hung.where("x > least").distinct().select(F.col("x").alias("b"), F.col("least").alias("a"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return both.where("v > u").join(least, "u").where("v > least").select(F.col("v").alias("b"), F.col("least").alias("a")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    return _starred(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), keep_self=True)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long nodes -> (node, root): root is the least node of the component, for nodes that have a link.

    Self links and repeated links count for nothing; no links give an empty table. Rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder, the one before is deleted.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct()
    edges = scratch(edges, "edges")
    before = _digest(edges)
    while before[0]:
        after_edges = scratch(_small_star(_large_star(edges)), "edges")
        after = _digest(after_edges)
        drop_scratch(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
